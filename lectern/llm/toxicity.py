"""Toxicity by a factorization machine over hashed terms.

Terms are letter runs, lower-cased in A-Z, and their first 4 to 10 bytes, hashed into
2^20 buckets; a text is the set of its buckets. The machine adds a weight for each bucket
and the inner product of two factor vectors for each pair, so a pair of terms can count
for more, or less, than its parts. It is fitted on a bounded sample of labelled texts, over
the buckets that tell the classes apart in that sample, alone or in a pair: what a first
machine over the buckets that do so alone leaves unexplained is summed over the texts of
every pair of buckets, and those of pairs that depart from chance join a second machine.

Defined results: null and empty texts have no terms and get the bias's score; without
labels, or with labels of one class, every text gets the share of that label (0 without
any); a label is the largest given for an id, null labels are left out; rows that repeat
get equal scores; a null id is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import kernels as kn
from lectern.llm import scratch
from lectern.sources.layout import spread

BITS = 20
PREFIXES = (4, 5, 6, 7, 8, 9, 10)
#: Labelled rows of each class that the machine is fitted on at most; those with the lowest hash of the id.
SAMPLE_ROWS = 6000
#: Buckets that the first machine has weights for at most, and the least distance from independence, in deviations.
FEATURES, LEAST_Z, LEAST_DOCS = 4096, 5.0, 3
FACTORS, UPDATES, BATCH, RATE, DECAY = 8, 1500, 512, 0.2, 1e-4
#: Share of a text's terms that an update sees: terms that mostly come together learn to count alone too.
KEEP = 0.8
#: Chance that any pair of independent terms is taken for an interaction; the least deviations of a pair, and the least variance of a text.
PAIR_CHANCE, LEAST_PAIR_Z, LEAST_VARIANCE = 0.01, 4.0, 0.0475
#: Pair counts of one task, about.
PAIR_WORK = 1 << 28
#: A text is toxic from this score on.
TOXIC = 0.7

_APART = np.ones(256, dtype=bool)
_APART[65:91] = _APART[97:123] = _APART[128:] = False


def terms(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every term, repeats included."""
    words = kn.split_words(data, bounds, _APART)
    doc = words.doc()
    docs, found = [doc], [words.hashes(lower=True)]
    for n in PREFIXES:
        long = np.flatnonzero(words.end - words.start > n)
        part = kn.Words(data, bounds, words.start[long], words.start[long] + n, words.first)
        docs.append(doc[long])
        found.append(kn.mix(part.hashes(lower=True) ^ kn.U64(n)))
    return np.concatenate(docs), (np.concatenate(found) >> kn.U64(64 - BITS)).astype(np.int64)


def term_sets(data: np.ndarray, bounds: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of each distinct term, by document; with `known`, its index there in place of buckets, others left out."""
    doc, bucket = terms(data, bounds)
    if known is not None:
        bucket = known[bucket]
        doc, bucket = doc[bucket >= 0], bucket[bucket >= 0]
    pairs = np.unique(doc.astype(np.int64) << 32 | bucket)
    return pairs >> 32, pairs & 0xFFFFFFFF


@dataclass
class Machine:
    buckets: np.ndarray  # of its features
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def known(self) -> np.ndarray:
        out = np.full(1 << BITS, -1, dtype=np.int32)
        out[self.buckets] = np.arange(len(self.buckets))
        return out

    def scores(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        total = np.full(n, self.bias)
        total += np.bincount(doc, self.weights[feature], n)
        for f in self.factors.T:
            x = f[feature]
            total += 0.5 * (np.bincount(doc, x, n) ** 2 - np.bincount(doc, x * x, n))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_machine(sets: list[np.ndarray], labels: np.ndarray, buckets: np.ndarray, keep: float = KEEP, seed: int = 7) -> Machine:
    """Logistic loss, AdaGrad over fixed batches; sets hold indices into buckets."""
    rng = np.random.default_rng(seed)
    n = len(buckets)
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
    bias = float(np.log(share / (1 - share)))
    w, v = np.zeros(n), rng.normal(0, 0.05, (n, FACTORS))
    gw, gv, gb = np.full(n, 1e-6), np.full((n, FACTORS), 1e-6), 1e-6
    order = rng.permutation(len(sets))
    batches = []
    for low in range(0, len(order), BATCH):
        rows = order[low : low + BATCH]
        sizes = np.array([len(sets[r]) for r in rows])
        feature = np.concatenate([sets[r] for r in rows]).astype(np.int64)
        doc = np.repeat(np.arange(len(rows)), sizes)
        by = np.argsort(feature, kind="stable")
        batches.append((feature[by], doc[by], labels[rows]))
    for _ in range(-(-UPDATES // len(batches))):
        for feature, doc, y in batches:
            m = len(y)
            seen = rng.random(len(feature)) < keep
            feature, doc = feature[seen], doc[seen]
            x = v[feature]
            sums = np.stack([np.bincount(doc, c, m) for c in x.T], 1)
            raw = bias + np.bincount(doc, w[feature], m) + 0.5 * ((sums**2).sum(1) - np.bincount(doc, (x * x).sum(1), m))
            off = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y) / m
            g = off.sum()
            gb += g * g
            bias -= RATE * g / np.sqrt(gb)
            if not len(feature):
                continue
            head = np.flatnonzero(np.append(True, feature[1:] != feature[:-1]))
            touched = feature[head]
            d = np.add.reduceat(off[doc], head) + DECAY * w[touched]
            gw[touched] += d * d
            w[touched] -= RATE * d / np.sqrt(gw[touched])
            d = np.add.reduceat(off[doc][:, None] * (sums[doc] - x), head, axis=0) + DECAY * v[touched]
            gv[touched] += d * d
            v[touched] -= RATE * d / np.sqrt(gv[touched])
    return Machine(buckets, bias, w, v)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), dtype=np.int64)
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False)
        for low, _, data, bounds in kn.slices(batch.column(0)):
            doc, bucket = term_sets(data, bounds)
            counts[0] += np.bincount(bucket, minlength=1 << BITS)
            counts[1] += np.bincount(bucket[toxic[low + doc] == 1], minlength=1 << BITS)
    there = np.flatnonzero(counts[0])
    for low in range(0, len(there), 1 << 16):
        part = there[low : low + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[0][part]), pa.array(counts[1][part])], names=["bucket", "n", "toxic"])


def _sample_sets(known: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, bounds in kn.slices(batch.column(0)):
                doc, feature = term_sets(data, bounds, known)
                cuts = np.searchsorted(doc, np.arange(high - low + 1))
                sets = [feature[i:j].astype(np.int32).tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(low, high - low), batch.column(2).slice(low, high - low), pa.array(sets, pa.binary())], names=["toxic", "h", "features"])

    return run


def unexplained(scores: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a text's label is above its score, and the variance granted to that; at least its square, so that no text counts for more than one deviation."""
    left = toxic - scores
    return left, np.maximum(np.maximum(left * left, scores * (1 - scores)), LEAST_VARIANCE)


def _left_over(machine: Machine):
    """The most that pairs with each bucket can reach: with every text's share left**2 / variance, a sum over texts
    with both terms is, squared and over its variance, at most the shares of those texts (Cauchy-Schwarz)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = machine.known()
        sums = np.zeros((2, 1 << BITS))
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for low, high, data, bounds in kn.slices(batch.column(0)):
                doc, bucket = term_sets(data, bounds)
                told = known[bucket] >= 0
                left, variance = unexplained(machine.scores(doc[told], known[bucket[told]], high - low), toxic[low:high])
                for side, share in enumerate((np.where(left > 0, left * left / variance, 0), np.where(left < 0, left * left / variance, 0))):
                    sums[side] += np.bincount(bucket, share[doc], 1 << BITS)
        there = np.flatnonzero(sums.any(0))
        for low in range(0, len(there), 1 << 16):
            part = there[low : low + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(sums[0][part]), pa.array(sums[1][part])], names=["bucket", "above", "below"])

    return run


def _left_sets(machine: Machine, wanted: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, known = machine.known(), wanted.known()
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for low, high, data, bounds in kn.slices(batch.column(0)):
                doc, bucket = term_sets(data, bounds)
                own = told[bucket] >= 0
                left, variance = unexplained(machine.scores(doc[own], told[bucket[own]], high - low), toxic[low:high])
                own = known[bucket] >= 0
                doc, bucket = doc[own], known[bucket[own]]
                cuts = np.searchsorted(doc, np.arange(high - low + 1))
                sets = [bucket[i:j].astype(np.int32).tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(variance), pa.array(sets, pa.binary())], names=["left", "variance", "features"])

    return run


def paired(sets: list[np.ndarray], left: np.ndarray, variance: np.ndarray, n: int, least_z: float, part: int = 0, parts: int = 1) -> np.ndarray:
    """Which of n terms are in a pair whose texts' left-overs sum to least_z deviations or more; sets hold each
    text's terms in order. The pairs of every `parts`-th term as the lower one, from `part` on."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate([*sets, np.zeros(0, dtype=np.int32)])
    doc = np.repeat(np.arange(len(sets)), sizes)
    rest = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat)) - 1  # terms of the text after this one
    by = np.argsort(flat, kind="stable")
    cuts = np.searchsorted(flat[by], np.arange(n + 1))
    found = np.zeros(n, dtype=bool)
    for term in range(part, n, parts):
        at = by[cuts[term] : cuts[term + 1]]
        many = rest[at]
        partner = flat[np.repeat(at + 1 - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        total = np.bincount(partner, np.repeat(left[doc[at]], many), n)
        spread = np.bincount(partner, np.repeat(variance[doc[at]], many), n)
        hit = (total * total >= least_z * least_z * spread) & (spread > 0)
        if hit.any():
            found |= hit
            found[term] = True
    return np.flatnonzero(found)


def pair_terms(sample: DataFrame, machine: Machine) -> np.ndarray:
    """Buckets of the pairs that say more about the sample's labels than the machine does. Every pair is looked at
    but those that cannot reach the bound; the bound grows with the number of terms, so that chance rarely gets there."""
    reach = F.greatest("above", "below")
    counted = sample.select("text", "toxic").mapInArrow(_left_over(machine), "bucket long, above double, below double").groupBy("bucket").agg(F.sum("above").alias("above"), F.sum("below").alias("below"))
    # to the driver: at most 2^20 buckets, of which those with LEAST_PAIR_Z^2 unexplained texts or more
    able = counted.select("bucket", reach.alias("reach")).where(F.col("reach") >= LEAST_PAIR_Z**2).toPandas().sort_values("bucket")
    least_z = max(LEAST_PAIR_Z, -NormalDist().inv_cdf(PAIR_CHANCE / max(1, len(able)) ** 2))
    buckets = able["bucket"].to_numpy(dtype=np.int64)[able["reach"].to_numpy() >= least_z**2 * (1 - 1e-9)]
    n = len(buckets)
    if n < 2:
        return np.zeros(0, dtype=np.int64)
    wanted = Machine(buckets, 0.0, np.zeros(n), np.zeros((n, FACTORS)))
    rows = sample.select("text", "toxic").mapInArrow(_left_sets(machine, wanted), "left double, variance double, features binary").collect()
    sets = [np.frombuffer(r["features"], dtype=np.int32) for r in rows]
    left, variance = np.array([r["left"] for r in rows]), np.array([r["variance"] for r in rows])
    parts = max(1, min(n, sum(len(s) ** 2 for s in sets) // PAIR_WORK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(paired(sets, left, variance, n, least_z, part, parts))], names=["term"])

    found = sample.sparkSession.range(0, parts, 1, parts).mapInArrow(run, "term long").distinct().collect()
    return buckets[np.array(sorted(r["term"] for r in found), dtype=np.int64)]


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """A machine fitted on at most `rows` labelled texts of each class; held-out ids are never among them."""
    known = labels.select(F.col("doc_id").cast("long").alias("_lx_id"), F.col("toxic").cast("int").alias("toxic")).where("_lx_id is not null and toxic in (0, 1)")
    known = known.where(~held_out(F.col("_lx_id"))).groupBy("_lx_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("_lx_id"))
    chosen = known.where("toxic = 1").orderBy("h").limit(rows).union(known.where("toxic = 0").orderBy("h").limit(rows))
    # broadcast: at most 2 * rows ids, by the two limits
    source = docs.select(F.col(id_col).cast("long").alias("_lx_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sample = scratch.materialize(source.join(F.broadcast(chosen), "_lx_id").select("text", "toxic", "h"), "toxicity-sample")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    none = np.zeros(0, dtype=np.int64)
    if len(sizes) < 2:
        share = float(next(iter(sizes), 0))
        return Machine(none, 30.0 if share else -30.0, np.zeros(0), np.zeros((0, FACTORS)))
    total, toxic = sum(sizes.values()), sizes[1]
    p = toxic / total
    counted = sample.select("text", "toxic").mapInArrow(_count_terms, "bucket long, n long, toxic long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    z = F.abs(F.col("toxic") - F.col("n") * p) / F.sqrt(F.col("n") * (p * (1 - p)) * (1 - F.col("n") / (total + 1)) + 1e-9)
    told = counted.where(F.col("n") >= min(LEAST_DOCS, max(1, toxic // 20))).withColumn("z", z).where(F.col("z") >= min(LEAST_Z, toxic**0.5)).orderBy(F.desc("z"), "bucket").limit(FEATURES)
    buckets = np.array(sorted(r["bucket"] for r in told.collect()), dtype=np.int64)
    machine = _fit_on(sample, buckets)
    together = np.union1d(buckets, pair_terms(sample, machine))
    return machine if len(together) == len(buckets) else _fit_on(sample, together)


def _fit_on(sample: DataFrame, buckets: np.ndarray) -> Machine:
    machine = Machine(buckets, 0.0, np.zeros(len(buckets)), np.zeros((len(buckets), FACTORS)))
    rows = sorted(((r["h"], r["toxic"], bytes(r["features"])) for r in sample.select("text", "toxic", "h").mapInArrow(_sample_sets(machine.known()), "toxic int, h long, features binary").collect()))
    return fit_machine([np.frombuffer(r[2], dtype=np.int32) for r in rows], np.array([float(r[1]) for r in rows]), buckets)


def _score(machine: Machine, at: int, fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = machine.known()
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for low, high, data, bounds in kn.slices(batch.column(at)):
                doc, feature = term_sets(data, bounds, known)
                scores[low:high] = machine.scores(doc, feature, high - low)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=fields)

    return run


def score(docs: DataFrame, machine: Machine, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with the score of every whole text in column `name`; one of that name is replaced."""
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    plain = docs.select(*[quoted(c).cast("string").alias(c) if c == text_col else quoted(c) for c in docs.columns if c != name])
    schema = T.StructType([*plain.schema.fields, T.StructField(name, T.DoubleType())])
    return plain.mapInArrow(_score(machine, plain.columns.index(text_col), schema.names), schema)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    machine = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, machine)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
