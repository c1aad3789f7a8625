"""CSV with line breaks in quoted cells, read by many tasks a file.

Whether a line break ends a record depends on the quotes before it: it does after an even
number of them. So the lines are scanned twice. The first scan counts, for each split, its
quotes and the lines that would start a record with an even and with an odd number of them
before the split; prefix sums over the splits then say with which number each split starts,
and how many records start before it. In the second scan each split puts its records
together; one that goes over its border comes in pieces, at most two a split, which meet by
the record's number.

Cells are quoted as CSV writers do, with a quote inside doubled; quotes within unquoted cells
are refused, since they hide where records end. Blank lines between records are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SPLIT = pa.schema([("_rank", pa.int64()), ("_block", pa.int64()), ("odd", pa.bool_()), ("even_starts", pa.int64()), ("odd_starts", pa.int64())])
_PIECE = pa.schema([("_rank", pa.int64()), ("_block", pa.int64()), ("number", pa.int64()), ("whole", pa.bool_()), ("text", pa.string()), ("src_file", pa.string())])


def _parities(lines: pa.Array, before: int) -> tuple[np.ndarray, np.ndarray]:
    """(quotes before each line modulo 2, with the number after the last; which lines are not blank)."""
    quotes = pc.fill_null(pc.count_substring(lines, '"'), 0).to_numpy(zero_copy_only=False)
    parity = np.concatenate([[before], before + np.cumsum(quotes)]) & 1
    return parity, np.asarray(pc.not_equal(pc.utf8_trim_whitespace(lines), ""))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """The batch by splits, which follow one another."""
    rank, block = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    cuts = np.flatnonzero((np.diff(rank) != 0) | (np.diff(block) != 0)) + 1
    for low, high in zip([0, *cuts], [*cuts, len(rank)], strict=True):
        if low < high:
            yield (int(rank[low]), int(block[low])), batch.slice(low, high - low)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a split: (_rank, _block, value) lines in order."""
    held: dict[tuple[int, int], list[int]] = {}
    for batch in batches:
        for key, run in _runs(batch):
            own = held.setdefault(key, [0, 0, 0])
            parity, full = _parities(run.column(2), own[0])
            own[0] = int(parity[-1])
            own[1] += int((full & (parity[:-1] == 0)).sum())
            own[2] += int((full & (parity[:-1] == 1)).sum())
    if held:
        columns = zip(*[(r, b, bool(odd), even, other) for (r, b), (odd, even, other) in held.items()], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SPLIT, strict=True)], schema=_SPLIT)


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of (_rank, _block, value, odd before, records before, file): whole ones, and pieces of those over a border."""
    key, parity, number, open_lines, starts_here, name = None, 0, 0, [], False, None

    def piece(whole: bool) -> tuple:
        return (*key, number, whole, "\n".join(open_lines), name)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECE, strict=True)], schema=_PIECE)

    for batch in batches:
        rows: list[tuple] = []
        for own, run in _runs(batch):
            if own != key:
                if open_lines:
                    rows.append(piece(False))
                key, open_lines, starts_here = own, [], False
                parity, number, name = int(run.column(3)[0].as_py()), run.column(4)[0].as_py() - 1, run.column(5)[0].as_py()
            before, full = _parities(run.column(2), parity)
            parity = int(before[-1])
            for line, odd, ends, some in zip(run.column(2).to_pylist(), before[:-1].tolist(), (before[1:] == 0).tolist(), full.tolist(), strict=True):
                if not odd:
                    if not some:
                        continue
                    number += 1
                    starts_here = True
                open_lines.append(line)
                if ends:
                    rows.append(piece(starts_here))
                    open_lines, starts_here = [], False
        if rows:
            yield batch_of(rows)
    if open_lines:
        yield batch_of([piece(False)])


def records(spark: SparkSession, path: str) -> DataFrame:
    """(_rank, number, text, src_file): the records of all files by name, number from 0 in each file, header included."""
    from lectern.sources.readers import _located, few_splits

    scan = spark.read.text(path, lineSep="\n")
    lines = _located(scan).select("_rank", "_block", "value", "src_file")
    splits = lines.select("_rank", "_block", "value").mapInArrow(_summed, "_rank long, _block long, odd boolean, even_starts long, odd_starts long")
    # a split is read by one task, in one run; a row for each split from here on
    before = Window.partitionBy("_rank").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_odd", F.coalesce(F.sum(F.col("odd").cast("int")).over(before) % 2, F.lit(0)).cast("long"))
    starts = F.when(F.col("_odd") == 0, F.col("even_starts")).otherwise(F.col("odd_starts"))
    splits = splits.select("_rank", "_block", "_odd", F.coalesce(F.sum(starts).over(before), F.lit(0)).alias("_before"))
    if not few_splits(scan):
        raise ValueError("too many splits to send their counts to all tasks; read the files in several parts, or with larger spark.sql.files.maxPartitionBytes")
    # the lines stay in their tasks and order
    met = lines.join(F.broadcast(splits), ["_rank", "_block"]).select("_rank", "_block", "value", "_odd", "_before", "src_file")
    pieces = met.mapInArrow(_assembled, "_rank long, _block long, number long, whole boolean, text string, src_file string")
    parts = pieces.where("not whole").groupBy("_rank", "number").agg(F.sort_array(F.collect_list(F.struct("_block", "text"))).alias("parts"), F.first("src_file").alias("src_file"))
    joined = parts.select("_rank", "number", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"), "src_file")
    return pieces.where("whole").select("_rank", "number", "text", "src_file").union(joined)


def read_quoted(spark: SparkSession, path: str, schema: str, place_bits: int) -> DataFrame:
    """The cells of a CSV with headers, with ord and src_file; empty cells are null. A header that is not the schema's, a
    cell that doesn't parse or a record with more or fewer cells is an error."""
    rows = records(spark, path)
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    options = {"quote": '"', "escape": '"', "nullValue": "", "mode": "FAILFAST", "multiLine": "true"}
    text = F.regexp_replace("text", "\r$", "")
    cells = ", ".join(f"`{n}` string" for n in names)
    wrong = lambda what: F.raise_error(F.concat(F.lit(what), F.substring("text", 1, 200)))
    header = F.from_csv(text, cells, options)
    same = F.array(*[F.trim(F.coalesce(header[n], F.lit(""))) for n in names]) == F.array(*[F.lit(n) for n in names])
    checked = F.when(F.col("number") > 0, F.from_csv(text, schema, options)).when(same, F.lit(None)).otherwise(wrong("not the header: ").cast(spark.createDataFrame([], schema).schema))
    parsed = rows.select("_rank", "number", "src_file", checked.alias("cells")).where("cells is not null")
    return parsed.select("cells.*", F.shiftleft("_rank", place_bits).bitwiseOR(F.col("number") - 1).alias("ord"), "src_file")
