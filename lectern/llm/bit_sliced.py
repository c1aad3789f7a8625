"""Exact top-k inner products over a bit-sliced index.

Rows are dealt into blocks. In a block each component, less the block's least value of it,
is quantised to a few bits and stored as slices: bitmaps over the block's rows, one for
each bit. For a query the slices are added up, shifted by the bits of the component's
weight and complemented where it is negative, in carry-save bitmap arithmetic; the sum's
slices bound each row's score. The rows of the k best sums are found from the most
significant slice downward; every row whose bound reaches theirs is a boundary row and is
resolved by its exact score.

A tile is a block of rows and a batch of queries. Its task reads the block, then the batch,
one after the other from a sorted partition. A block is sent once for each batch of
QUERY_ROWS queries, and a query once for each block; only where that makes fewer tiles
than there are cores are batches smaller.

Defined results: vectors that are null or hold null or non-finite components take no part;
of rows that repeat an id, one counts (the least vector); shorter vectors count as if
filled up with zeros; ties go to the smaller id; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import scratch

#: Rows of an index block and queries of a batch, on average; bits kept of a component.
BLOCK_ROWS, QUERY_ROWS, BITS = 1 << 16, 1 << 14, 7
#: Tiles that one task works off at most, on average.
TASK_TILES = 64
SCALE = 256


def quantised(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(which vectors take part, floor(SCALE * x) of those)."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    good = np.asarray(vectors.is_valid())
    size = np.where(good, np.asarray(vectors.value_lengths().fill_null(0)), 0).astype(np.int64)
    values = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes nan
    row = np.repeat(np.arange(len(size)), size)
    good[row[~np.isfinite(values)]] = False
    out = np.zeros((len(size), int(size[good].max(initial=0))), dtype=np.int64)
    kept = good[row]
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    out[row[kept], at[kept]] = np.floor(SCALE * values[kept])
    return good, out[good]


def _pack_bits(bits: np.ndarray) -> np.ndarray:
    raw = np.packbits(bits, bitorder="little")
    return np.pad(raw, (0, -len(raw) % 8)).view(np.uint64)


class Block:
    """The rows of a block, ascending by id, and their slices."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, bits: int = BITS):
        self.ids, self.vectors = ids, vectors
        self.low = vectors.min(axis=0)
        spread = int((vectors.max(axis=0) - self.low).max()) if vectors.size else 0
        self.shift = max(0, spread.bit_length() - bits)
        kept = (vectors - self.low) >> self.shift
        self.bits = max(1, int(kept.max()).bit_length()) if kept.size else 1
        self.all = _pack_bits(np.ones(len(ids), dtype=bool))
        self.slices = [[_pack_bits((kept[:, d] >> b) & 1 == 1) for b in range(self.bits)] for d in range(vectors.shape[1])]

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of the sum over components of |q| times the quantised
        component, or times its complement where q is negative."""
        held: list[list[np.ndarray]] = []
        for q, own in zip(query.tolist(), self.slices, strict=True):
            weight = -q if q < 0 else q
            if q < 0:
                own = [~s for s in own]
            at = 0
            while weight:
                if weight & 1:
                    while len(held) < at + self.bits:
                        held.append([])
                    for b, s in enumerate(own):
                        held[at + b].append(s)
                weight >>= 1
                at += 1
        out, at = [], 0
        while at < len(held):
            column = held[at]
            if len(column) > 1 and at + 1 == len(held):
                held.append([])
            while len(column) > 2:  # a full adder: three bitmaps become a sum here and a carry above
                a, b, c = column.pop(), column.pop(), column.pop()
                x = a ^ b
                column.insert(0, x ^ c)
                held[at + 1].append((a & b) | (c & x))
            if len(column) == 2:
                a, b = column
                held[at + 1].append(a & b)
                column = [a ^ b]
            out.append(column[0] & self.all if column else np.zeros_like(self.all))
            at += 1
        return out

    def top(self, query: np.ndarray, own_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows but the query's own."""
        width = self.vectors.shape[1]
        if len(query) != width:  # zeros of either side add nothing
            query = np.pad(query[:width], (0, max(0, width - len(query))))
        sums = self.sums(query)
        want = min(k + 1, len(self.ids))
        sure, tied, bound = np.zeros_like(self.all), self.all, 0
        for s in reversed(sums):
            with_bit = tied & s
            bound <<= 1
            if int(np.bitwise_count(sure).sum() + np.bitwise_count(with_bit).sum()) >= want:
                tied, bound = with_bit, bound | 1
            else:
                sure, tied = sure | with_bit, tied & ~s
        # a component's lost bits shift a score by less than |q| << shift; exact scores decide within that
        slack = int(np.abs(query).sum()) * ((1 << self.shift) - 1)
        least = max(0, bound - -(-slack >> self.shift) - 1) if self.shift else bound
        above, equal = np.zeros_like(self.all), self.all
        for i in range(len(sums) - 1, -1, -1):
            if least >> i & 1:
                equal = equal & sums[i]
            else:
                above, equal = above | (equal & sums[i]), equal & ~sums[i]
        rows = np.flatnonzero(np.unpackbits((above | equal).view(np.uint8), bitorder="little", count=len(self.ids)))
        rows = rows[self.ids[rows] != own_id]
        scores = self.vectors[rows] @ query
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[best]], scores[best]


def _numbers(array: np.ndarray) -> bytes:
    return array.astype(np.int16).tobytes() if not array.size or np.abs(array).max() < 1 << 15 else array.astype(np.int64).tobytes()


def _of_numbers(raw: bytes, n: int, width: int) -> np.ndarray:
    kind = np.int16 if len(raw) == 2 * n * width else np.int64
    return np.frombuffer(raw, dtype=kind).astype(np.int64).reshape(n, width)


_GROUP = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("width", pa.int32()), ("numbers", pa.binary())])


def _gather(table: pa.Table) -> pa.Table:
    """A block's rows that take part, one for each id, as one row."""
    good, numbers = quantised(table.column("vector"))
    ids = table.column("vec_id").to_numpy()[good]
    order = np.lexsort((*numbers.T[::-1], ids))
    ids, numbers = ids[order], numbers[order]
    first = np.append(True, ids[1:] != ids[:-1]) if len(ids) else np.zeros(0, dtype=bool)
    ids, numbers = ids[first], numbers[first]
    if not len(ids):
        return pa.Table.from_arrays([pa.array([], f.type) for f in _GROUP], schema=_GROUP)
    return pa.Table.from_arrays([pa.array([table.column("block")[0].as_py()]), pa.array([ids.tobytes()]), pa.array([numbers.shape[1]], pa.int32()), pa.array([_numbers(numbers)])], schema=_GROUP)


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _tiles(k: int, bits: int):
    """Rows sorted by block and batch, each batch after a copy of its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                number, asked, ids, width, numbers = (batch.column(j)[i].as_py() for j in range(5))
                ids = np.frombuffer(ids, dtype=np.int64)
                if not asked:
                    if held != number:
                        block, held = Block(ids, _of_numbers(numbers, len(ids), width), bits), number
                    continue
                if held != number:  # a block without rows has no index
                    continue
                rows: list[tuple[int, int, int]] = []
                for q, query in zip(ids.tolist(), _of_numbers(numbers, len(ids), width), strict=True):
                    found, scores = block.top(query, q, k)
                    rows += [(q, v, s) for v, s in zip(found.tolist(), scores.tolist(), strict=True)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_FOUND)

    return run


def exact_top_k(rows: DataFrame, every: int, k: int = 5, bits: int = BITS, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of every row whose id is divisible by `every`, the k best other rows."""
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    source = rows.select(quoted(id_col).cast("long").alias("vec_id"), quoted(vector_col).cast("array<double>").alias("vector")).where("vec_id is not null")
    queries = F.col("vec_id") % every == 0
    n_rows, n_queries = source.agg(F.count("*"), F.count_if(queries)).first()  # one row
    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n_rows // block_rows))
    batches = max(1, -(-n_queries // query_rows), min(-(-n_queries // 16), -(-2 * cores // blocks)))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("long").alias("block")
    layout = "block long, ids binary, width int, numbers binary"
    gathered = lambda frame, n: frame.select(deal(n), "vec_id", "vector").groupBy("block").applyInArrow(_gather, layout)
    index = scratch.materialize(gathered(source, blocks), "slices")
    asked = gathered(source.where(queries), batches)
    copies = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)
    sent = index.select("block", copies(batches, "batch"), F.lit(False).alias("asked"), "ids", "width", "numbers")
    sent = sent.union(asked.select(copies(blocks, "block"), F.col("block").alias("batch"), F.lit(True).alias("asked"), "ids", "width", "numbers"))
    tile = F.col("block") * batches + F.col("batch")
    tasks = max(1, min(blocks * batches, max(4 * cores, blocks * batches // TASK_TILES)))
    # tiles that follow each other go to one task, so that it reads a block's slices once
    task = F.floor(tile * tasks / (blocks * batches)).cast("int")
    met = sent.repartitionById(tasks, task).sortWithinPartitions("block", "batch", "asked").select("block", "asked", "ids", "width", "numbers")
    found = met.mapInArrow(_tiles(k, bits), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=50)


ORACLE = """
with v as (select vec_id, [floor(256 * x::double)::bigint for x in embedding] as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum([a[1] * a[2] for a in list_zip(q.v, c.v)])::bigint as score
      from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
