"""Best-fit packing in bulk-synchronous steps over range-sorted documents and gaps.

Every text becomes token ids plus an end id; only documents longer than a sequence are
cut. Documents and gaps are rows of one table, sorted by range: their place is the number
of rows in longer classes, counted, and their rank in their own class. Two kinds of
superstep run over that table until no document waits:

* Match. A sweep from the longest class down raises a level by one for each gap and lowers
  it for each document. The last gap at the level that a document leaves is its successor,
  the smallest gap that holds it and that no longer document has taken; so a conflict over
  a gap goes to the higher rank, and the others take the next gap up. Levels are windows of
  their own, of two rows for each class at most, however many documents there are.
* Open. Documents that no gap holds need at least as many new sequences as their tokens
  fill, and one each above half a sequence. So many are opened, and the documents are dealt
  to them in order of rank, as many turns as fit in any case.

Gaps shrink by what they took, and the steps repeat. The driver holds one count for each
class. Short documents of one length go in bundles of up to a 64th of a sequence, which
bounds the steps.

Defined results: null texts are empty, and an empty text is the end id alone; rows that
repeat are packed each on their own; a null id stays null; a text of any length is cut into
pieces of a sequence; other columns are not used.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import kernels as kn
from lectern.llm import scratch
from lectern.sources.layout import spread

SEQUENCE = 1024
END_ID = 2
#: Documents of one length go in bundles of up to this part of a sequence.
BUNDLES = 64
#: Runs into which each class is salted for ranking: one for so many rows in all, and this many at least.
LEAST_SALTS, ROWS_PER_SALT = 64, 1 << 16
#: Rows of a superstep's table for each task, beyond one task a core.
ROWS_PER_TASK = 1 << 17
GAP, DOC = 0, 1


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def tokenizer(json_path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_path)


@lru_cache(maxsize=2)
def ranked(json_path: str, ranks_path: str):
    """The same vocabulary as ranks, with the special tokens of json_path."""
    import base64
    import json

    import tiktoken
    from public_tokenizers import PATTERN

    with open(json_path, encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encode(text: str, paths: tuple[str, str]) -> np.ndarray:
    """Ids as the tokenizer in paths[0] gives them.

    Texts within Latin-1 go through the same vocabulary as ranks, which is several times
    faster; others go to the tokenizer itself, whose Unicode tables may differ.
    """
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return np.array(tokenizer(paths[0]).encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    return ranked(*paths).encode_to_numpy(text, allowed_special="all")


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _pieces(limit: int, end_id: int, paths: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), kn.as_strings(batch.column(1)), strict=True):
                ids = np.append(encode(text.as_py(), paths).astype("<u4"), np.uint32(end_id))
                at = 0
                for piece in range(-(-len(ids) // limit)):
                    to = at + ((len(ids) - 1) % limit + 1 if piece == 0 else limit)
                    rows.append((doc_id, piece, at, to - at, zlib.crc32(ids[at:to].tobytes())))
                    at = to
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)

    return run


def _salted(rows: DataFrame, n: int) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(max(LEAST_SALTS, n // ROWS_PER_SALT))).cast("int"))


def _placed(rows: DataFrame, classes: list[tuple[int, int, int]], n: int) -> DataFrame:
    """rows (kind, size, id) with `base`, which `classes` holds for each (kind, size), and their rank in that class."""
    salted = _salted(rows, n)
    own = Window.partitionBy("kind", "size", "salt").orderBy("id")
    earlier = Window.partitionBy("kind", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = salted.groupBy("kind", "size", "salt").agg(F.count("*").alias("n")).select("kind", "size", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    bases = rows.sparkSession.createDataFrame(classes, "kind int, size int, base long")  # two rows for each size at most
    ranked = salted.withColumn("rank", F.row_number().over(own) - 1).join(before, ["kind", "size", "salt"])
    return ranked.join(F.broadcast(bases), ["kind", "size"]).select("kind", "size", "id", "base", (F.col("rank") + F.col("before")).alias("rank"))


def _match(state: DataFrame, counts: dict[tuple[int, int], int], limit: int) -> DataFrame:
    """Each document in the smallest gap that holds it, longer ones first, one for each gap; gaps with what is left of them."""
    level, classes = 0, []
    for kind, size in sorted(counts, key=lambda c: (-c[1], c[0])):
        classes.append((kind, size, level))
        level += counts[kind, size] if kind == GAP else -counts[kind, size]
    rows = _placed(state, classes, sum(counts.values()))
    rows = rows.withColumn("level", F.when(F.col("kind") == GAP, F.col("base") + F.col("rank")).otherwise(F.col("base") - 1 - F.col("rank")))
    swept = Window.partitionBy("level").orderBy(F.col("size").desc(), "kind")
    beside = lambda f: f(F.struct("kind", "size", "id")).over(swept)
    rows = rows.select("kind", "size", "id", beside(F.lag).alias("up"), beside(F.lead).alias("down"))
    meets = f"kind = {DOC} and up.kind = {GAP}"
    return rows.selectExpr(
        "kind",
        f"case when kind = {GAP} and down.kind = {DOC} then size - down.size else size end as size",
        "id",
        f"case when {meets} then up.id end as sequence",
        f"case when {meets} then {limit} - up.size end as at",
    )


def _open(state: DataFrame, waiting: dict[int, int], most: int, first: int, limit: int) -> tuple[DataFrame, int]:
    """New sequences for the documents above `most`, the largest gap, dealt out by rank; and how many there are."""
    many = max(sum(n for size, n in waiting.items() if 2 * size > limit), -(-sum(size * n for size, n in waiting.items()) // limit))
    turns = limit // max(waiting)
    place, classes = 0, []
    for size in sorted(waiting, reverse=True):
        classes.append((DOC, size, place))
        place += waiting[size]
    above = f"kind = {DOC} and size > {most}"
    rows = _placed(state.where(above), classes, place).selectExpr("kind", "size", "id", "base + rank as place")
    rows = rows.selectExpr("kind", "size", "id", f"case when place < {many * turns} then 2 * ({first} + place % {many}) end as sequence", "place")
    if turns > 1:
        # documents that wait on are told apart by their place, so that they share no window
        turn = Window.partitionBy(F.coalesce("sequence", -1 - F.col("place"))).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("at", F.coalesce(F.sum("size").over(turn), F.lit(0)))
    else:
        rows = rows.withColumn("at", F.lit(0))
    rows = rows.selectExpr("kind", "size", "id", "sequence", "cast(if(sequence is null, null, at) as int) as at")
    others = state.where(f"not ({above})").selectExpr("kind", "size", "id", "cast(null as long) as sequence", "cast(null as int) as at")
    return rows.union(others), many


def best_fit(units: DataFrame, limit: int) -> DataFrame:
    """(id, sequence, at) for units (id, size) of sizes below limit; sequences have even numbers."""
    spark = units.sparkSession
    state, steps, first = units.select(F.lit(DOC).alias("kind"), F.col("size").cast("int").alias("size"), "id"), [], 0
    while True:
        counts = {(r["kind"], r["size"]): r["n"] for r in state.groupBy("kind", "size").agg(F.count("*").alias("n")).collect()}  # two rows for each size at most
        sizes = [size for kind, size in counts if kind == DOC]
        if not sizes:
            break
        # gaps that hold no document that waits are done
        counts = {c: n for c, n in counts.items() if c[0] == DOC or c[1] >= min(sizes)}
        state = state.where(f"kind = {DOC} or size >= {min(sizes)}")
        most = max((size for kind, size in counts if kind == GAP), default=0)
        if max(sizes) > most:
            step, opened = _open(state, {size: counts[DOC, size] for size in sizes if size > most}, most, first, limit)
            first += opened
        else:
            step, opened = _match(state, counts, limit), 0
        tasks = max(spark.sparkContext.defaultParallelism, sum(counts.values()) // ROWS_PER_TASK)
        step = scratch.materialize(step.selectExpr("kind", "size", "id", "sequence", "cast(at as int) as at").coalesce(tasks), "superstep")
        taken = step.where("sequence is not null")
        steps.append(taken.select("id", "sequence", "at"))
        state = step.where("sequence is null").select("kind", "size", "id")
        if opened:
            gaps = taken.groupBy("sequence").agg(F.sum("size").alias("size"))
            state = state.union(gaps.selectExpr(f"{GAP} as kind", f"cast({limit} - size as int) as size", "sequence as id"))
    return reduce(DataFrame.union, steps) if steps else spark.createDataFrame([], "id long, sequence long, at int")


def _bundled(pieces: DataFrame, limit: int) -> DataFrame:
    """pieces with `unit`, the id of the bundle that they go in, and `turn`, their place there."""
    small = limit // BUNDLES
    alone = pieces.where(f"length > {small}").withColumn("unit", F.col("id")).withColumn("turn", F.lit(0))
    if not small:
        return alone
    salts = scratch.parts(pieces, 1 << 20, LEAST_SALTS)
    own = Window.partitionBy("length", "salt").orderBy("id")
    short = pieces.where(f"length <= {small}").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).withColumn("rank", F.row_number().over(own) - 1)
    short = short.withColumn("turn", F.expr(f"cast(rank % ({small} div length) as int)")).withColumn("bundle", F.expr(f"rank div ({small} div length)"))
    short = short.withColumn("unit", F.min("id").over(Window.partitionBy("length", "salt", "bundle")))
    return alone.union(short.select(*alone.columns))


def pack(docs: DataFrame, limit: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    source = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    pieces = source.mapInArrow(_pieces(limit, end_id, paths or tokenizer_paths()), "doc_id long, piece int, start long, length long, ids_crc32 long")
    # numbers are written with the rows, so that they hold for all that follows
    pieces = scratch.materialize(pieces.withColumn("id", F.monotonically_increasing_id()), "pieces")
    whole = pieces.where(f"length = {limit}").select("doc_id", "piece", "start", "length", "ids_crc32", F.expr("2 * id + 1").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    members = scratch.materialize(_bundled(pieces.where(f"length < {limit}"), limit), "members")
    units = members.groupBy("unit").agg(F.sum("length").alias("size")).withColumnRenamed("unit", "id")
    placed = best_fit(units, limit).withColumnRenamed("id", "unit")
    packed = members.join(placed, "unit").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("sequence").alias("sequence_id"), (F.col("at") + F.col("turn") * F.col("length")).cast("long").alias("offset"))
    return whole.union(packed)


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
