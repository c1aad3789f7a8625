"""Approximate nearest neighbours: an inverted-list index whose lists are scanned dimension by dimension.

* Fit. Centroids of lists, and how many lists a query probes, come from a sample of at most
  SAMPLE_BYTES: the probes are as many as hold TARGET of the sample's own neighbours. Every
  row is put into the list of its nearest centroid.
* Index. A row's residual to its centroid is turned by a random rotation, which keeps
  distances and makes any first m of D dimensions a fair sample of all. A list's rows are
  stored in blocks, by columns of WIDTH dimensions.
* Scan. A query starts with its nearest rows of the sample; the distance of the last of
  them is an upper bound. In a block the columns are added up one after another; with m dimensions seen, a
  candidate whose partial distance is above bound * m / D * (1 + SLACK / sqrt(m)) ** 2 is
  abandoned: were it within the bound, so large a part would be unlikely. The bound falls
  as nearer rows are found. Those left get their exact distance on the original vectors.

Rows with equal vectors are one row of the index, with their k + 1 smallest ids: no more can
be among the k nearest of any row, since ties go to the smaller id. Nothing else is cut.

Defined results: vectors that are null, zero, empty or hold null or non-finite components
take no part; of rows that repeat an id the least vector counts; shorter vectors count as if
filled up with zeros; distances that overflow are infinite; ties go to the smaller id;
other columns are not used. Distances are exact; which rows are found is approximate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import scratch
from lectern.operators.places import any_larger

#: Bytes of the sample that centroids, probes and first bounds come from, and its rows at most; rows of it that bounds use.
SAMPLE_BYTES, SAMPLE_ROWS, BOUND_ROWS = 16 << 20, 1 << 15, 1 << 12
#: Lists at most: their centroids go to every task.
MOST_LISTS = 1 << 12
#: Share of the sample's neighbours that lie in the probed lists.
TARGET = 0.97
#: Dimensions of a column block, and how far a partial distance may be above its share (standard errors).
WIDTH, SLACK = 16, 2.5
#: Rows of a block and queries that meet it at once.
BLOCK_ROWS, QUERY_ROWS = 1 << 14, 1 << 10
SEED = 20260501


@dataclass(frozen=True)
class Fit:
    """What is sent to every task, all of it bounded by the sample; `kind` is how vectors are stored."""

    width: int
    kind: str
    centroids: np.ndarray
    rotation: np.ndarray
    sample: np.ndarray
    sample_ids: list[np.ndarray]
    probes: int


def parsed(vectors: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(which vectors take part, those as doubles, filled up with zeros)."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    good = np.asarray(vectors.is_valid())
    size = np.where(good, np.asarray(vectors.value_lengths().fill_null(0)), 0).astype(np.int64)
    values = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes nan
    row = np.repeat(np.arange(len(size)), size)
    good[row[~np.isfinite(values)]] = False
    out = np.zeros((len(size), int(size.max(initial=0)) if width is None else width))
    kept = good[row]
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    out[row[kept], at[kept]] = values[kept]
    good &= (out != 0).any(axis=1)
    return good, out[good]


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs, for choosing lists and bounds."""
    with np.errstate(all="ignore"):
        return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1), 0)


def clustered(sample: np.ndarray, lists: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """Lloyd's centroids of the sample; empty ones move to rows far from theirs."""
    centroids = sample[rng.permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        near, far = [], []
        for low in range(0, len(sample), 4096):
            d = squared(sample[low : low + 4096], centroids)
            near.append(d.argmin(1))
            far.append(d.min(1))
        own = np.concatenate(near)
        counts = np.bincount(own, minlength=lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        full = counts > 0
        centroids[full] = sums[full] / counts[full][:, None]
        if not full.all():
            centroids[~full] = sample[np.argsort(-np.concatenate(far), kind="stable")[: int((~full).sum())]]
    return centroids


def calibrated(sample: np.ndarray, centroids: np.ndarray, k: int, target: float, rng: np.random.Generator) -> int:
    """Lists to probe so that `target` of the sample's k nearest lie in them, measured on some of its rows."""
    if len(sample) < 2:
        return 1
    asked = rng.permutation(len(sample))[:256]
    d = squared(sample[asked], sample)
    d[np.arange(len(asked)), asked] = np.inf
    nearest = np.argsort(d, axis=1)[:, : min(k, len(sample) - 1)]
    own = np.concatenate([squared(sample[low : low + 4096], centroids).argmin(1) for low in range(0, len(sample), 4096)])
    rank = np.argsort(np.argsort(squared(sample[asked], centroids), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(rank, own[nearest], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))]) + 1


def fit(classes: DataFrame, n_classes: int, width: int, kind: str, k: int, target: float = TARGET, seed: int = SEED) -> Fit:
    """Centroids, rotation, probes and the sample for bounds, from at most SAMPLE_BYTES of distinct vectors."""
    most = max(64, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * width)))
    # a share of hashes, so that no task sends more than its part of the sample
    share = min(1 << 30, int((1 << 30) * 1.1 * most / max(n_classes, 1)) + 1)
    rows = classes.where(F.pmod(F.xxhash64("vector", F.lit(seed)), F.lit(1 << 30)) < share).select("vector", "ids").limit(most).collect()
    rows.sort(key=lambda r: bytes(r[0]))
    sample = np.stack([np.frombuffer(r[0], dtype=kind).astype(float) for r in rows]) if rows else np.zeros((0, width))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(sample))
    sample = sample[order]
    lists = max(1, min(MOST_LISTS, len(sample) // 16, round(n_classes**0.5)))
    centroids = clustered(sample, lists, rng) if len(sample) else np.zeros((1, width))
    probes = calibrated(sample, centroids, k, target, rng)
    rotation = np.linalg.qr(rng.standard_normal((width, width)))[0]
    first = max(BOUND_ROWS, k + 1)
    return Fit(width, kind, centroids, rotation, sample[:first], [np.array(rows[i][1], dtype=np.int64) for i in order[:first]], probes)


def _prepare(width: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, vectors = parsed(batch.column(1), width)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.array([v.tobytes() for v in vectors.astype(kind)], pa.binary())], names=["vec_id", "vector"])

    return run


def _matrix(column: pa.Array, width: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width)


def _assign(found: Fit, probes: int, bounds: int):
    """Rows with their list, or each of their `probes` nearest lists, the residual turned, and an upper bound of the
    squared distance to the `bounds`-th neighbour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                batch = whole.slice(low, 1024)
                rows = _matrix(batch.column(1), found.width, found.kind).astype(float)
                d = squared(rows, found.centroids)
                lists = np.argsort(d, axis=1, kind="stable")[:, :probes] if probes > 1 else d.argmin(1)[:, None]
                bound = np.full(len(rows), np.inf)
                if bounds and len(found.sample) >= bounds:
                    bound = np.partition(squared(rows, found.sample), bounds - 1, axis=1)[:, bounds - 1]
                n, times = lists.shape
                at = np.repeat(np.arange(n), times)
                with np.errstate(all="ignore"):
                    turned = ((rows[at] - found.centroids[lists.ravel()]) @ found.rotation).astype("<f4")
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists.ravel().astype(np.int32)), batch.column(0).take(take), batch.column(1).take(take), pa.array([t.tobytes() for t in turned], pa.binary()), pa.array(bound[at]), batch.column(2).take(take)],
                    names=["list", "class", "vector", "turned", "bound", "ids"],
                )

    return run


def _seeds(found: Fit, k: int):
    """(class, vec_id, score): of each query the k + 1 nearest rows of the sample, and their equals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                batch = whole.slice(low, 1024)
                rows = _matrix(batch.column(1), found.width, found.kind).astype(float)
                near = np.argsort(squared(rows, found.sample), axis=1, kind="stable")[:, : k + 1]
                at = np.repeat(np.arange(len(rows)), near.shape[1])
                with np.errstate(all="ignore"):
                    score = np.sqrt(((found.sample[near.ravel()] - rows[at]) ** 2).sum(axis=1))
                ids = [found.sample_ids[j] for j in near.ravel()]
                times = [len(i) for i in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(at, times))), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64)), pa.array(np.repeat(score, times))], names=["class", "vec_id", "score"])

    return run


def _abandoned(columns: list[np.ndarray], asked: list[np.ndarray], bound: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the pairs whose partial distances never rose above what the bound lets expect."""
    width = sum(c.shape[1] for c in columns)
    seen, at, row, part = 0, None, None, None
    # what single precision may put a squared distance off by
    off = 2e-6 * (sum((q.astype(float) ** 2).sum(1) for q in asked) + max((sum((c.astype(float) ** 2).sum(1) for c in columns)).max(initial=0), 0))
    with np.errstate(all="ignore"):
        for x, q in zip(columns, asked, strict=True):
            if at is None:
                part = squared(q, x).ravel()
                at, row = np.repeat(np.arange(len(q)), len(x)), np.tile(np.arange(len(x)), len(q))
            else:
                part = part + ((x[row] - q[at]) ** 2).sum(1)
            seen += x.shape[1]
            # a value that is no number is never abandoned
            limit = bound * (1 if seen == width else seen / width * (1 + slack / np.sqrt(seen)) ** 2) + off
            keep = ~(part > limit[at])
            at, row, part = at[keep], row[keep], part[keep]
    return at, row


def _scan(k: int, width: int, kind: str, block_width: int, slack: float):
    """The k + 1 nearest (score, vec_id) of each query in its block."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        held = table.filter(pc.invert(table.column("asked")))
        queries = table.filter(table.column("asked"))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if held.num_rows and queries.num_rows:
            rows, turned = _matrix(held.column("vector"), width, kind), _matrix(held.column("turned"), width, "<f4")
            members = held.column("ids").combine_chunks()
            size = np.asarray(members.value_lengths())
            first, ids = np.cumsum(size) - size, np.asarray(members.flatten())
            columns = [np.ascontiguousarray(turned[:, c : c + block_width]) for c in range(0, width, block_width)]
            q_rows, q_turned = _matrix(queries.column("vector"), width, kind), _matrix(queries.column("turned"), width, "<f4")
            q_ids, bound = np.asarray(queries.column("class").combine_chunks()), np.asarray(queries.column("bound").combine_chunks()).copy()
            for low in range(0, len(columns[0]), 1024):  # rows of a block at once: the bound falls from one part to the next
                part = [c[low : low + 1024] for c in columns]
                for begin in range(0, len(q_rows), 128):
                    here = slice(begin, begin + 128)
                    at, row = _abandoned(part, [q_turned[here, c : c + block_width] for c in range(0, width, block_width)], bound[here], slack)
                    at, row = at + begin, row + low
                    with np.errstate(all="ignore"):
                        score = np.sqrt(((rows[row].astype(float) - q_rows[at]) ** 2).sum(axis=1))
                    # a class of equal vectors counts with all its ids
                    times = size[row]
                    take = np.repeat(np.arange(len(row)), times)
                    vec = ids[np.arange(len(take)) - np.repeat(np.cumsum(times) - times, times) + first[row][take]]
                    at, score = at[take], score[take]
                    order = np.lexsort((vec, score, at))
                    at, vec, score = at[order], vec[order], score[order]
                    rank = np.arange(len(at)) - np.searchsorted(at, at, "left")
                    keep = rank <= k
                    out.append((q_ids[at[keep]], vec[keep], score[keep]))
                    # with k + 1 rows found here, no farther one is needed
                    last = rank == k
                    np.minimum.at(bound, at[last], score[last] ** 2 * (1 + 1e-9))
        asked, vec, score = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((vec, score, asked))
        asked, vec, score = asked[order], vec[order], score[order]
        keep = np.arange(len(asked)) - np.searchsorted(asked, asked, "left") <= k
        return pa.table({"class": pa.array(asked[keep], pa.int64()), "vec_id": pa.array(vec[keep], pa.int64()), "score": pa.array(score[keep], pa.float64())})

    return run


def nearest(rows: DataFrame, every: int, k: int = 10, target: float = TARGET, slack: float = SLACK, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of every row whose id is divisible by `every`, the k nearest other rows found.
    target = 1 probes every list, and an infinite slack abandons nobody early: then the result is exact."""
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    single = isinstance(rows.schema[vector_col].dataType.elementType, T.FloatType)
    kind = "<f4" if single else "<f8"
    source = rows.select(quoted(id_col).cast("long").alias("vec_id"), quoted(vector_col).cast("array<float>" if single else "array<double>").alias("vector")).where("vec_id is not null and size(vector) > 0")
    width = source.agg(F.max(F.size("vector"))).first()[0] or 1  # one row
    vectors = source.mapInArrow(_prepare(width, kind), "vec_id long, vector binary")
    if any_larger(source, ["vec_id"], 1):
        vectors = vectors.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    vectors = scratch.materialize(vectors, "vectors")
    # the k + 1 smallest ids of each distinct vector: a rank limit, kept before the shuffle too
    order = Window.partitionBy("vector").orderBy("vec_id")
    few = vectors.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    classes = few.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = scratch.materialize(classes.withColumn("class", F.col("ids")[0]), "classes")
    n_classes = classes.count()
    found = fit(classes, n_classes, width, kind, k, target)
    probes = len(found.centroids) if target >= 1 else found.probes
    layout = "list int, class long, vector binary, turned binary, bound double, ids array<long>"
    index = scratch.materialize(classes.select("class", "vector", "ids").mapInArrow(_assign(found, 1, 0), layout), "index")
    asked = vectors.where(F.col("vec_id") % every == 0).join(classes.select("class", "vector"), "vector").select(F.col("vec_id").alias("query_id"), "class", "vector")
    asked = scratch.materialize(asked, "queries")
    # equal queries are one; it sees itself or its equals, so its bound is that of one neighbour more
    distinct = scratch.materialize(asked.groupBy("class").agg(F.first("vector").alias("vector")).withColumn("ids", F.lit(None).cast("array<long>")), "asked")
    seeds = distinct.mapInArrow(_seeds(found, k), "class long, vec_id long, score double")
    probed = scratch.materialize(distinct.mapInArrow(_assign(found, probes, k + 1), layout), "probes")
    blocks = index.groupBy("list").agg(F.ceil(F.count("*") / block_rows).cast("long").alias("blocks"))
    groups = probed.groupBy("list").agg(F.ceil(F.count("*") / query_rows).cast("long").alias("groups"))
    sizes = scratch.materialize(blocks.join(groups, "list"), "tiles")  # a row for each list
    one = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("long")
    every_one = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    sent = index.join(sizes, "list").select("list", one("blocks").alias("block"), every_one("groups").alias("group"), F.lit(False).alias("asked"), "class", "vector", "turned", "bound", "ids")
    sent = sent.union(probed.join(sizes, "list").select("list", every_one("blocks").alias("block"), one("groups").alias("group"), F.lit(True).alias("asked"), "class", "vector", "turned", "bound", "ids"))
    near = sent.groupBy("list", "block", "group").applyInArrow(_scan(k, width, kind, WIDTH, slack), "class long, vec_id long, score double")
    # a row found twice has the same exact score, and the same rank
    best = Window.partitionBy("class").orderBy("score", "vec_id")
    near = near.union(seeds).withColumn("rank", F.dense_rank().over(best)).where(F.col("rank") <= k + 1).select("class", "vec_id", "score").distinct()
    other = asked.select("query_id", "class").join(near, "class").where("vec_id <> query_id")
    own = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return other.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op12_adaptive_scan(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), every=100)
