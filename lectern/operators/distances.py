"""Edit distances of texts too long for one cell of a distance table in one task.

A pair's table is cut into tiles. A tile needs only the differences along its upper and left border, and gives those
along its lower and right one, so tiles of one anti-diagonal are filled side by side, each in memory that is linear in
its side. Inside a tile, rows are bits of integers: a column of `STRIPE` rows takes a dozen operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import text as tx
from lectern.sources.layout import fresh_folder, spread, stored

#: Cells of a distance table up to which the built-in function fills it; beyond, columns of bits are faster.
SHORT = 1 << 18
#: Characters of a tile's side: some ten seconds a tile.
TILE = 1 << 17
#: Bytes of borders that a task hands on at once.
BATCH = 1 << 24
#: Rows of a tile that are held as bits of one integer.
STRIPE = 1 << 14


def _stripe(ref: np.ndarray, hyp: list[int], plus: int, minus: int, across: np.ndarray) -> tuple[int, int]:
    """Rows of `ref` against all columns. plus, minus: rows of the left border where the distance grows or falls by one,
    as bits; returned for the right border. across: the same as 1, 0, -1 along the upper border, replaced by the lower one's."""
    every, top = (1 << len(ref)) - 1, len(ref) - 1
    masks = {}
    for unit in np.unique(ref).tolist():
        masks[unit] = int.from_bytes(np.packbits(ref == unit, bitorder="little").tobytes(), "little")
    below = []
    for unit, step in zip(hyp, across.tolist(), strict=True):
        equal = masks.get(unit, 0)
        kept = equal | minus
        if step < 0:
            equal |= 1
        diagonal = (((equal & plus) + plus) ^ plus) | equal | minus
        grows = minus | (every & ~(diagonal | plus))
        falls = plus & diagonal
        below.append((grows >> top & 1) - (falls >> top & 1))
        grows, falls = grows << 1 & every, falls << 1 & every
        if step > 0:
            grows |= 1
        elif step < 0:
            falls |= 1
        plus = falls | (every & ~(kept | grows))
        minus = grows & kept
    across[:] = below
    return plus, minus


def tile(ref: str, hyp: str, left: bytes | None = None, above: bytes | None = None) -> tuple[bytes, bytes]:
    """(right, lower) border of the tile of ref's rows and hyp's columns; without a border the table begins there."""
    rows, columns = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4") for t in (ref, hyp))
    units = columns.tolist()
    across = np.ones(len(units), dtype=np.int8) if above is None else np.frombuffer(above, dtype=np.int8).copy()
    right, at = [], 0
    for low in range(0, len(rows), STRIPE):
        own = rows[low : low + STRIPE]
        size = -(-len(own) // 8)
        if left is None:
            plus, minus = (1 << len(own)) - 1, 0
        else:
            plus, minus = (int.from_bytes(left[at + k * size : at + (k + 1) * size], "little") for k in (0, 1))
            at += 2 * size
        for border in _stripe(own, units, plus, minus, across):
            right.append(border.to_bytes(size, "little"))
    return b"".join(right), across.tobytes()


def _subsequence(short: str, long: str) -> bool:
    rest = iter(long)
    return all(c in rest for c in short)


@F.arrow_udf(T.LongType())
def _dropped(refs: pa.Array, hyps: pa.Array) -> pa.Array:
    """The distance of texts of which one is the other with characters left out, else null. No alignment takes fewer
    edits than lengths differ, and only such texts take no more: one walk through both tells, without a table."""
    out: list[int | None] = []
    for low in range(0, len(refs), tx.AT_ONCE):
        for ref, hyp in zip(*(t.slice(low, tx.AT_ONCE).to_pylist() for t in (refs, hyps)), strict=True):
            short, long = sorted((ref or "", hyp or ""), key=len)
            out.append(len(long) - len(short) if None not in (ref, hyp) and _subsequence(short, long) else None)
    return pa.array(out, pa.int64())


_FILLED = "_pair long, i int, j int, v binary, h binary, total long"
_BORDERS = ["_pair", "i", "j", "v", "h", "total"]


def _fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    filled, size = [], 0
    for pdf in batches:
        for row in pdf.itertuples(index=False):  # a row is a tile
            v, h = tile(row.r, row.c, row.v, row.h)
            filled.append((row.pair, row.i, row.j, v, h, int(np.frombuffer(h, dtype=np.int8).sum(dtype=np.int64))))
            size += len(v) + len(h)
            if size >= BATCH:
                yield pd.DataFrame(filled, columns=_BORDERS)
                filled, size = [], 0
    if filled:
        yield pd.DataFrame(filled, columns=_BORDERS)


def edits(rows: DataFrame, ref: str = "ref", hyp: str = "hyp", out: str = "char_edits", tile_side: int = TILE, short: int = SHORT) -> DataFrame:
    """rows with `out`, the edit distance over code points of two texts of any length; null beside a null text.

    Equal pairs, and those of up to `short` cells, take the built-in function. Of longer ones those that differ by omissions
    of one side only are told by a walk through both texts. The others go through rounds, one for each
    anti-diagonal of the longest pair's tiles; of all pairs, the tiles of a round are filled side by side, and a round's
    borders are stored, so that a lost executor costs its tiles only. Rows may repeat and have further columns.
    """
    spark = rows.sparkSession
    plain = F.coalesce((F.col(ref) == F.col(hyp)) | (F.length(ref).cast("long") * F.length(hyp) <= short), F.lit(True))
    walked = _dropped(*[F.when(~plain, F.col(side)) for side in (ref, hyp)])
    paired = spread(stored(rows.withColumn("_pair", F.monotonically_increasing_id()).withColumn("_walked", walked), "pairs"))
    builtin = F.when(plain, tx.char_edits(F.col(ref), F.col(hyp))).otherwise(F.col("_walked"))
    long_ones = paired.where(~plain & F.col("_walked").isNull())
    tiles_of = lambda side: F.ceil(F.length(side) / tile_side).cast("int")
    height, width = long_ones.agg(F.max(tiles_of(ref)), F.max(tiles_of(hyp))).first()
    if height is None:
        return paired.withColumn(out, builtin).drop("_pair", "_walked")

    def parts(side: str, number: str, name: str) -> DataFrame:
        cut = long_ones.select("_pair", F.col(side).alias(name), F.explode(F.sequence(F.lit(0), tiles_of(side) - 1)).alias(number))
        return stored(cut.withColumn(name, F.substring(name, F.col(number) * tile_side + 1, F.lit(tile_side))), "parts")

    down, across = parts(ref, "i", "r"), parts(hyp, "j", "c")
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    folder, before = fresh_folder(spark, "tiles"), None
    for turn in range(height + width - 1):
        met = down.join(across.withColumn("i", F.lit(turn) - F.col("j")), ["_pair", "i"])
        if before is None:
            met = met.withColumns({"v": F.lit(None).cast("binary"), "h": F.lit(None).cast("binary")})
        else:
            met = met.join(before.select("_pair", "i", (F.col("j") + 1).alias("j"), "v"), ["_pair", "i", "j"], "left")
            met = met.join(before.select("_pair", (F.col("i") + 1).alias("i"), "j", "h"), ["_pair", "i", "j"], "left")
        filled = met.select(F.col("_pair").alias("pair"), "i", "j", "r", "c", "v", "h").repartition(tasks, "pair", "i", "j").mapInPandas(_fill, _FILLED)
        filled.write.parquet(f"{folder}/turn={turn}")
        before = spark.read.schema(_FILLED).parquet(f"{folder}/turn={turn}")
    # the distance grows by one a row down the left border, then by what the last row of tiles adds
    last = spark.read.schema(_FILLED).parquet(*[f"{folder}/turn={t}" for t in range(height + width - 1)]).select("_pair", "i", "total")
    added = long_ones.select("_pair", (tiles_of(ref) - 1).alias("i"), F.length(ref).cast("long").alias("_n")).join(last, ["_pair", "i"])
    found = added.groupBy("_pair").agg((F.first("_n") + F.sum("total")).alias("_long"))
    return paired.join(found, "_pair", "left").withColumn(out, F.coalesce(builtin, "_long")).drop("_pair", "_walked", "_long")
