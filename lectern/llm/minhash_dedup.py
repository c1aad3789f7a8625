"""Near-duplicate documents through an inverted join over MinHash coordinates.

1. Each text becomes a set of 5-word shingles, a 128-bit hash of that set, and K minimum
   hashes. Texts with equal sets form a class that its smallest id stands for.
2. A class is posted under its (coordinate, value) pairs. Two sets at the similarity bound
   share T of K pairs but for a chance below 1e-5, so pairs that occur once are skipped,
   classes with fewer than T shared pairs are left out, and of the rest only a prefix is
   joined: of the pairs in order of frequency, all but the T - 1 most frequent.
3. Inside a posting list nobody meets everybody. Its most typical member leads it and meets
   the others: pairs count their collisions over the whole signature, and those with T or
   more are confirmed on the full shingle sets. Confirmed links give components.
4. Lists that lie in one component are done. In the others the members outside the main
   component meet the rest, in tiles, on their full sets; sets that share too few shingles
   with all others of such lists to be similar to any are skipped.

A pair of one component needs no link of its own, so no component is lost by not meeting.

Words are hashed by SipHash in two lanes under keys of their own. A set is ordered and signed
by the first; shingles count as shared only if they are alike in both, 128 bits.

Defined results: null, empty or blank texts have an empty set and are linked with nothing;
rows with a null id are kept and linked with nothing; rows that repeat an id count once,
by the set that hashes lowest, and get the same result; other columns pass through, but
for those with a result column's name, which are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import kernels as kn
from lectern.llm import scratch
from lectern.llm.components import components
from lectern.sources.layout import spread

SHINGLE = 5
#: Coordinates, and how many of them two sets must share to be compared in full:
#: a pair with similarity 0.75 shares fewer with a chance of 4e-6 (binomial).
COORDINATES, MATCHES = 48, 22
#: Outsiders and members of a posting list that meet in one tile, on average.
TILE = (128, 512)
#: Buckets of shingles at least, of about 1 MB each: above a set's size, so that a set has about a row for each of its
#: shingles at every size, and rows grow with the shingles, not with sets times buckets.
LEAST_BUCKETS = 1024
RESULT = ("n_shingles", "component_id", "kept")

_A = kn.mix(np.arange(1, 257, dtype=np.uint64)) | kn.U64(1)
_B = kn.mix(np.arange(1001, 1257, dtype=np.uint64))


def shingle_sets(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes of the documents' sets, their shingle hashes, ascending in each document, the second lane's hashes)."""
    words = kn.split_words(data, bounds)
    tokens = words.tokens(lower=True)
    lanes = [words.keyed(lane, tokens=tokens) for lane in (0, 1)]
    counts = words.counts
    inside = np.flatnonzero(kn.inside(words.first, SHINGLE))
    docs = [words.doc()[inside]]
    found = [[kn.grams(h, SHINGLE)[inside]] for h in lanes]
    for c in range(1, SHINGLE):
        short = np.flatnonzero(counts == c)
        if len(short):
            docs.append(short)
            for h, f in zip(lanes, found, strict=True):
                f.append(kn.mix(kn.grams(h, c)[words.first[short]] ^ kn.U64(0xA5A5 * c)))
    doc, (shingle, check) = np.concatenate(docs), (np.concatenate(f) for f in found)
    order = np.lexsort((shingle, doc))
    doc, shingle, check = doc[order], shingle[order], check[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])
    return np.bincount(doc[new], minlength=len(counts)), shingle[new], check[new]


def packed_sets(sizes: np.ndarray, shingles: np.ndarray, checks: np.ndarray) -> list[bytes]:
    """Each document's set: its shingles, then their second lane."""
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    return [shingles[i:j].tobytes() + checks[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def unpacked(raw: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(raw.as_buffer(), dtype=np.uint64)
    return both[: len(both) // 2], both[len(both) // 2 :]


def shared(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> int:
    """How many shingles two sets have in common, in both lanes."""
    if not len(x[0]) or not len(y[0]):
        return 0
    at = np.minimum(np.searchsorted(y[0], x[0]), len(y[0]) - 1)
    return int(((y[0][at] == x[0]) & (y[1][at] == x[1])).sum())


def signatures(sizes: np.ndarray, shingles: np.ndarray, k: int) -> np.ndarray:
    """k minimum hashes of 32 bits for each non-empty set."""
    full = sizes[sizes > 0]
    if not len(full):
        return np.zeros((0, k), dtype=np.uint32)
    at = np.cumsum(full) - full
    out = np.empty((len(full), k), dtype=np.uint32)
    for j in range(k):
        out[:, j] = np.minimum.reduceat(shingles * _A[j] + _B[j], at) >> kn.U64(32)
    return out


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("sig", pa.binary())])


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, bounds in kn.slices(batch.column(1)):
                sizes, shingles, checks = shingle_sets(data, bounds)
                full = sizes > 0
                # no sum of hashes: sets could be written whose sums agree
                digests = [hashlib.blake2b(x, digest_size=16).digest() for x in packed_sets(sizes, shingles, checks)]
                h1, h2 = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2).T
                sig: list[bytes | None] = [None] * len(sizes)
                for i, row in zip(np.flatnonzero(full), signatures(sizes, shingles, k), strict=True):
                    sig[i] = row.tobytes()
                ids = batch.column(0).slice(low, high - low)
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(h1), pa.array(h2), pa.array(sig, pa.binary())], schema=_SIGNED)

    return run


_POSTED = pa.schema([("doc_id", pa.int64()), ("key", pa.int64())])


def _post(k: int):
    lanes = np.arange(k, dtype=np.uint64) << kn.U64(32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(-1, k)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for low in range(0, len(ids), 2048):
                part = sig[low : low + 2048].astype(np.uint64) | lanes
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[low : low + 2048], k)), pa.array(part.reshape(-1).view(np.int64))], schema=_POSTED)

    return run


def _collide(k: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint32).reshape(-1, k) for c in (2, 3))
                keep = pa.array((left == right).sum(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(keep)

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, bounds in kn.slices(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(packed_sets(*shingle_sets(data, bounds)), pa.binary())], names=["doc_id", "shingles"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                x, y = unpacked(left), unpacked(right)
                m, n = len(x[0]), len(y[0])
                if 100 * min(m, n) < percent * max(m, n):
                    keep.append(False)
                    continue
                both = shared(x, y)
                keep.append(100 * both >= percent * (m + n - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _attach(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    left = table.select(F.col("doc_id").alias("a"), F.col(value).alias("left"))
    right = table.select(F.col("doc_id").alias("b"), F.col(value).alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")


def _deal(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            sets = [unpacked(x)[0] for x in batch.column(1)]
            if not len(ids):
                continue
            shingle, doc = np.concatenate(sets), np.repeat(ids, [len(x) for x in sets])
            bucket = shingle % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            there = [(k, order[i:j]) for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if i < j]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in there], pa.int64()), pa.array([shingle[at].tobytes() for _, at in there], pa.binary()), pa.array([doc[at].tobytes() for _, at in there], pa.binary())], names=["bucket", "shingles", "docs"])

    return run


def _count_shared(table: pa.Table) -> pa.Table:
    shingle = np.frombuffer(b"".join(table.column("shingles").to_pylist()), dtype=np.uint64)
    doc = np.frombuffer(b"".join(table.column("docs").to_pylist()), dtype=np.int64)
    _, at, n = np.unique(shingle, return_inverse=True, return_counts=True)
    ids, counts = np.unique(doc[n[at] > 1], return_counts=True)
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "shared": pa.array(counts, pa.int64())})


def _meet(percent: int):
    """Links between the outsiders and the members of a tile, no more than join its components."""

    def run(table: pa.Table) -> pa.Table:
        out = table.column("outside").to_numpy(zero_copy_only=False).astype(bool)
        ids, own = table.column("doc_id").to_numpy(), table.column("component").to_numpy()
        full = [unpacked(x) for x in table.column("shingles").combine_chunks()] if table.num_rows else []
        sets = [x for x, _ in full]
        there = np.flatnonzero(~out)
        size = np.array([len(sets[i]) for i in there], dtype=np.int64)
        shingle = np.concatenate([sets[i] for i in there]) if len(there) else np.zeros(0, dtype=np.uint64)
        order = np.argsort(shingle, kind="stable")
        shingle, place = shingle[order], np.repeat(np.arange(len(there)), size)[order]
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        a, b = [], []
        for i in np.flatnonzero(out):
            x = sets[i]
            low, high = np.searchsorted(shingle, x, "left"), np.searchsorted(shingle, x, "right")
            n = high - low
            at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            alike = np.bincount(place[at], minlength=len(there))
            for j in np.flatnonzero((alike > 0) & (100 * alike >= percent * (len(x) + size - alike))):
                u, v = find(int(own[i])), find(int(own[there[j]]))
                if u != v and 100 * (both := shared(full[i], full[there[j]])) >= percent * (len(x) + size[j] - both):
                    root[max(u, v)] = min(u, v)
                    a.append(int(ids[i]))
                    b.append(int(ids[there[j]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def met_apart(prefix: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of one posting list that are still in different components.

    In each list the members outside its main component meet the others, in tiles. Only
    those do whose set can reach the similarity at all: the shingles that a set shares with
    any other set here bound every intersection from above.
    """
    labelled = prefix.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    labelled = scratch.materialize(labelled, "labelled")
    by_component = labelled.groupBy("key", "component").agg(F.count("*").alias("n"))
    apart = by_component.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = scratch.materialize(labelled.join(apart, "key").withColumn("outside", F.col("component") != F.col("main")).drop("main"), "members")
    few = members.select("doc_id").distinct()
    own = scratch.materialize(sets.join(few, "doc_id", "left_semi"), "sets-apart")
    counts = own.mapInArrow(_deal(scratch.parts(own, 1 << 20, LEAST_BUCKETS)), "bucket long, shingles binary, docs binary").groupBy("bucket").applyInArrow(_count_shared, "doc_id long, shared long").groupBy("doc_id").agg(F.sum("shared").alias("shared"))
    facts = own.select("doc_id", (F.length("shingles") / 16).cast("long").alias("n")).join(counts, "doc_id")
    members = scratch.materialize(members.join(facts, "doc_id"), "members")
    # |x and y| >= p (|x| + |y|) / (100 + p), and a partner has at least p % of the size
    reaches = lambda least: F.expr(f"{100 + percent} * shared >= {percent} * (n + greatest({least}, ceil({percent} * n / 100)))")
    smallest = members.groupBy("key").agg(F.min("n").alias("least"))
    outside = members.where("outside").join(smallest, "key").where(reaches("least")).drop("least")
    lists = outside.groupBy("key").agg(F.count("*").alias("n_out"), F.min("n").alias("least_out"))
    inside = members.join(lists, "key").where(reaches("least_out"))
    sizes = inside.groupBy("key").agg(F.first("n_out").alias("n_out"), F.count("*").alias("n_in"))
    sizes = sizes.select("key", F.ceil(F.col("n_out") / TILE[0]).alias("tiles_out"), F.ceil(F.col("n_in") / TILE[1]).alias("tiles_in"))
    salt = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rows = outside.join(sizes, "key").select("key", salt("tiles_out").alias("i"), every("tiles_in").alias("j"), "doc_id", "component", F.lit(True).alias("outside"))
    rows = rows.union(inside.join(sizes, "key").select("key", every("tiles_out").alias("i"), salt("tiles_in").alias("j"), "doc_id", "component", F.lit(False).alias("outside")))
    return rows.join(own, "doc_id").groupBy("key", "i", "j").applyInArrow(_meet(percent), "a long, b long")


def near_links(docs: DataFrame, reps: DataFrame, k: int, least: int, percent: int) -> DataFrame:
    """Links between classes: (a, b) confirmed at percent or more, enough of them to connect every component."""
    posted = reps.select("doc_id", "sig").mapInArrow(_post(k), "doc_id long, key long")
    often = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = posted.join(often, "key").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("pairs"), F.sum("n").alias("weight")).where(F.size("pairs") >= least)
    prefix = shared.select("doc_id", "weight", F.explode(F.slice("pairs", F.lit(1), F.size("pairs") - (least - 1))).alias("p")).select("doc_id", "weight", F.col("p.key").alias("key"))
    prefix = scratch.materialize(prefix, "prefix")
    # the member whose pairs are the most frequent is the likeliest to be near all others
    lists = prefix.groupBy("key").agg(F.max_by("doc_id", F.struct(F.col("weight"), -F.col("doc_id"))).alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n")
    listed = scratch.materialize(prefix.join(lists, "key").select("key", "doc_id", "lead"), "listed")
    wanted = listed.select("doc_id").distinct()
    signed = scratch.materialize(reps.join(wanted, "doc_id", "left_semi").select("doc_id", "sig"), "signed")
    sets = scratch.materialize(docs.join(wanted, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_sets, "doc_id long, shingles binary"), "sets")
    pairs = listed.where("doc_id <> lead").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct()
    met = scratch.materialize(_attach(pairs, signed, "sig").mapInArrow(_collide(k, least), "a long, b long"), "met")
    links = scratch.materialize(_attach(met, sets, "shingles").mapInArrow(_confirm(percent), "a long, b long"), "links")
    return scratch.materialize(links.union(met_apart(listed.select("key", "doc_id"), components(links), sets, percent)), "links")


def minhash_dedup(docs: DataFrame, percent: int = 75, k: int = COORDINATES, least: int = MATCHES, id_col: str = "doc_id", text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with n_shingles, component_id (the smallest id that it is linked with, over any number of links)
    and kept, whose names begin with prefix."""
    names = [prefix + r for r in RESULT]
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    source = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    signed = scratch.materialize(source.mapInArrow(_sign(k), "doc_id long, n_shingles long, h1 long, h2 long, sig binary"), "signed")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    lowest = F.struct("doc_id", "sig")
    reps = scratch.materialize(full.groupBy("n_shingles", "h1", "h2").agg(F.min(lowest).alias("r")).select("n_shingles", "h1", "h2", "r.doc_id", "r.sig"), "classes")
    with scratch.last_kept(docs.sparkSession):  # the sets are larger than the texts
        labels = components(near_links(source.where("doc_id is not null"), reps, k, least, percent))
    classes = reps.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("n_shingles", "h1", "h2", F.coalesce("component", "doc_id").alias("component_id"))
    result = full.select("doc_id", "n_shingles", "h1", "h2").join(classes, ["n_shingles", "h1", "h2"]).groupBy(F.col("doc_id").alias("_lx_id")).agg(F.min(F.struct("component_id", "n_shingles")).alias("_lx"))
    plain = docs.select(*[quoted(c) for c in docs.columns if c not in names])
    joined = plain.join(result, quoted(id_col).cast("long") == F.col("_lx_id"), "left")
    own = quoted(id_col).cast("long")
    component = F.coalesce(F.col("_lx.component_id"), own)
    return joined.select(*[quoted(c) for c in plain.columns], F.coalesce(F.col("_lx.n_shingles"), F.lit(0)).alias(names[0]), component.alias(names[1]), F.coalesce(component == own, F.lit(True)).alias(names[2]))


def op10_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return minhash_dedup(docs).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, g from (
  select doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) >= 5)
  union all select doc_id, array_to_string(ws, ' ') from w where len(ws) between 1 and 4)),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id as id, doc_id as low from documents union select e.b, r.low from r join e on r.id = e.a where r.low < e.b),
m as (select id, min(low) as component_id from r group by id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept
from documents d left join n on n.doc_id = d.doc_id join m on m.id = d.doc_id
"""
