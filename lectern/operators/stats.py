"""Bootstrap intervals, verdicts, sweep selection and training-curve summaries."""

from __future__ import annotations

import math
import random
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators.places import any_larger, in_order, same
from lectern.sources.layout import stored

RESAMPLES, SEED, ALPHA = 1000, 42, 0.05
#: Resampling methods, which the caller chooses. "exact": the draws of Python's generator. "poisson": weights from a hash
#: of seed, place and resample, summed where the rows lie. Both for slices of any size.
METHODS = ("exact", "poisson")
#: Rows up to which a slice is resampled in one group; larger ones by ranges of so many places. Resamples of one block.
RANGE, BLOCK = 1 << 14, 8
#: Numbers taken from the generator at once.
CHUNK = 1 << 16
#: Rows that get their Poisson weights at once, so that their hashes stay in a core's cache.
AT_ONCE = 32
#: Above how many of 2^53 a hash means a weight of more than 0, 1, ...
POISSON_BOUNDS = [np.uint64(math.floor(c * (1 << 53))) for c in np.cumsum([math.exp(-1) / math.factorial(n) for n in range(16)]).tolist()]


class Draws:
    """How often each resample draws each of k segments, as Python's `randrange` would: the generator's words without
    their low bits, those of k or more passed over. Slices of one size see the same draws."""

    def __init__(self, k: int, seed: int = SEED, state: bytes | None = None):
        if not 0 < k < 1 << 32:
            raise ValueError(f"cannot draw from {k} segments")
        self.k, self.bits = k, k.bit_length()
        words = np.frombuffer(state, dtype=np.uint32) if state else np.array(random.Random(seed).getstate()[1], dtype=np.uint32)
        self.source = np.random.MT19937()
        self.source.state = {"bit_generator": "MT19937", "state": {"key": words[:624], "pos": int(words[624])}}
        self.words = np.random.Generator(self.source)  # whole words of 32 bits are the generator's own, in order
        self.rest = words[625:]  # taken from the generator, not yet drawn

    def state(self) -> bytes:
        """Where the generator is, for another one to go on from."""
        now = self.source.state["state"]
        return np.concatenate([now["key"], [now["pos"]], self.rest]).astype(np.uint32).tobytes()

    def _parts(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of the next resample, and where among them its draws are."""
        need = self.k
        while need:
            if not len(self.rest):
                self.rest = self.words.integers(0, 1 << 32, min(CHUNK, int(need * (1 << self.bits) / self.k) + 16), dtype=np.uint32)
            values = self.rest >> np.uint32(32 - self.bits)
            at = np.flatnonzero(values < self.k)[:need]
            need -= len(at)
            self.rest = self.rest[int(at[-1]) + 1 :] if not need else self.rest[:0]
            yield values, at

    def skip(self) -> None:
        for _ in self._parts():
            pass

    def counts(self, kind=np.int64) -> np.ndarray:
        out = np.zeros(self.k, dtype=kind)
        for values, at in self._parts():
            part = values[at].astype(np.int64)
            if len(part) * 8 > self.k:
                out += np.bincount(part, minlength=self.k).astype(kind)
            else:
                np.add.at(out, part, kind(1))  # one of another kind takes forty times as long
        return out


def draws(k: int, resamples: int = RESAMPLES, seed: int = SEED) -> Iterator[np.ndarray]:
    """How often each resample draws each of k segments."""
    drawn = Draws(k, seed)
    for _ in range(resamples):
        yield drawn.counts()


def _poisson(pos: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """Poisson(1) weights (row, resample) that depend on seed, place and resample only, not on how rows are dealt."""
    out = np.empty((len(pos), resamples))  # floats, which are multiplied as a matrix
    steps = np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed)
    for low in range(0, len(pos), AT_ONCE):
        x = pos[low : low + AT_ONCE].astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + steps
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(31)
        x >>= np.uint64(11)
        most, weights = x.max(initial=0), np.zeros(x.shape, dtype=np.uint8)
        for bound in POISSON_BOUNDS:
            if most <= bound:
                break
            weights += x > bound
        out[low : low + AT_ONCE] = weights
    return out


def _bounds(values: Column, n: Column, alpha: float) -> tuple[Column, Column]:
    """Nearest ranks by truncation, not interpolated."""
    low = F.floor(n * (alpha / 2)).cast("int")
    high = F.least(n - 1, F.floor(n * (1 - alpha / 2)).cast("int"))
    return F.get(values, low), F.get(values, high)


def _interval(resampled: DataFrame, slices: list[str], alpha: float) -> DataFrame:
    out = resampled.where("value is not null").groupBy(*slices).agg(F.sort_array(F.collect_list("value")).alias("values"))
    low, high = _bounds(F.col("values"), F.size("values"), alpha)
    return out.select(*slices, low.alias("lo"), high.alias("hi"))


def _resampled(rows: DataFrame, slices: list[str], values: list[str], resamples: int, seed: int, method: str) -> DataFrame:
    """(slices, b, values): the sums of each resample, by one of METHODS whatever the size. rows: (slices, pos, values)."""
    if method not in METHODS:
        raise ValueError(f"method has to be one of {METHODS}, not {method!r}")
    schema = T.StructType([*(rows.schema[c] for c in slices), T.StructField("b", T.IntegerType()), *(T.StructField(v, T.DoubleType()) for v in values)])

    def exact(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pos", *values])
        sums = np.array([w @ pdf[values].to_numpy(dtype=float) for w in draws(len(pdf), resamples, seed)])
        return _sums_frame({c: pdf[c].iloc[0] for c in slices}, sums, values)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for key, own in pdf.groupby(slices, dropna=False) if slices else [((), pdf)]:
                numbers = own[values].to_numpy(dtype=float)
                for low in range(0, len(own), 512):
                    part = _poisson(own["pos"].to_numpy()[low : low + 512], resamples, seed).T @ numbers[low : low + 512]
                    held[key] = held[key] + part if key in held else part
        for key, sums in held.items():
            yield _sums_frame(dict(zip(slices, key, strict=True)), sums, values)

    if method == "exact":
        rows = stored(rows, "resampled")
        sizes = rows.groupBy(*slices).agg(F.count("*").alias("_k"))
        met = rows.alias("l").join(sizes.alias("r"), same(slices)).select(*[F.col(f"l.`{c}`") for c in rows.columns], "_k")
        small = met.where(F.col("_k") <= RANGE).groupBy(*slices).applyInPandas(exact, schema)
        if not any_larger(rows, slices, RANGE):
            return small
        return small.union(_in_blocks(met.where(F.col("_k") > RANGE), slices, values, schema, resamples, seed))
    return rows.mapInPandas(partial, schema).groupBy(*slices, "b").agg(*[F.sum(v).alias(v) for v in values])


def _in_blocks(rows: DataFrame, slices: list[str], values: list[str], schema: T.StructType, resamples: int, seed: int) -> DataFrame:
    """The sums of slices too large for one group. Rows get their places in their slice and are packed by ranges of
    them. For each size of slice one task walks through the generator and notes its state for every BLOCK resamples;
    from there blocks are drawn side by side, one byte a place, as counts by range. Counts and values of a range meet,
    and their products are added up over ranges."""
    at = in_order(rows, slices, ["pos", *values]).withColumn("_range", F.floor(F.col("_place") / RANGE))
    packed = T.StructType([*(rows.schema[c] for c in slices), T.StructField("_k", T.LongType()), T.StructField("_range", T.LongType()), T.StructField("_values", T.BinaryType())])

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_place")
        first = {c: [pdf[c].iloc[0]] for c in (*slices, "_k", "_range")}
        return pd.DataFrame({**first, "_values": [pdf[values].to_numpy(dtype="<f8").tobytes()]})

    ranges = at.groupBy(*slices, "_k", "_range").applyInPandas(pack, packed)

    def noted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in pdf["_k"]:
                drawn = Draws(int(k), seed)
                for low in range(0, resamples, BLOCK):
                    yield pd.DataFrame({"_k": [k], "low": [low], "state": [drawn.state()]})
                    for _ in range(min(BLOCK, resamples - low)):
                        drawn.skip()

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, low, state in zip(pdf["_k"], pdf["low"], pdf["state"], strict=True):
                drawn = Draws(int(k), seed, state)
                for b in range(low, min(low + BLOCK, resamples)):
                    counts = drawn.counts(np.uint8)  # 255 draws of one of RANGE segments or more don't occur
                    parts = [counts[i : i + RANGE].tobytes() for i in range(0, k, RANGE)]
                    yield pd.DataFrame({"_k": [k] * len(parts), "_range": range(len(parts)), "b": [b] * len(parts), "counts": parts})

    # a walk takes as long as its slice has draws, so sizes are dealt over all tasks, few as their rows are; dealt by _k, as
    # they come, they would be put together again by their bytes
    sizes = rows.select("_k").distinct().repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    states = stored(sizes.mapInPandas(noted, "_k long, low int, state binary"), "states")
    blocks = -(-resamples // BLOCK)
    drawn = states.repartition(blocks, "_k", "low").mapInPandas(counted, "_k long, _range long, b int, counts binary")

    def met(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({f.name: [] for f in schema})
        counts = np.stack([np.frombuffer(c, dtype=np.uint8) for c in left["counts"]])
        out = []
        for row in right.to_dict("records"):
            own = np.frombuffer(row["_values"], dtype="<f8").reshape(-1, len(values))
            sums = np.concatenate([counts[i : i + 64].astype(float) @ own for i in range(0, len(counts), 64)])
            out.append(pd.DataFrame({**{c: [row[c]] * len(sums) for c in slices}, "b": left["b"].to_numpy(dtype=np.int32), **{v: sums[:, i] for i, v in enumerate(values)}}))
        return pd.concat(out)

    partial = drawn.groupBy("_k", "_range").cogroup(ranges.groupBy("_k", "_range")).applyInPandas(met, schema)
    return partial.groupBy(*slices, "b").agg(*[F.sum(v).alias(v) for v in values])


def _sums_frame(key: dict, sums: np.ndarray, values: list[str]) -> pd.DataFrame:
    return pd.DataFrame({**{c: [v] * len(sums) for c, v in key.items()}, "b": np.arange(len(sums), dtype=np.int32), **{v: sums[:, i] for i, v in enumerate(values)}})


def bootstrap_ci(counts: DataFrame, *slices: str, resamples: int = RESAMPLES, seed: int = SEED, alpha: float = ALPHA, method: str = "exact") -> DataFrame:
    """(slices, lo, hi, method) of the corpus rate. counts: (slices, ord, char_edits, char_ref_len)."""
    keys = list(slices)
    placed = counts.select(*keys, F.col("ord").cast("long").alias("pos"), F.col("char_edits").alias("e"), F.col("char_ref_len").alias("n"))
    sums = _resampled(placed, keys, ["e", "n"], resamples, seed, method)
    return _interval(sums.withColumn("value", F.when(F.col("n") > 0, F.col("e") / F.col("n"))), keys, alpha).withColumn("method", F.lit(method))


def bootstrap_delta_ci(pairs: DataFrame, *slices: str, resamples: int = RESAMPLES, seed: int = SEED, alpha: float = ALPHA, method: str = "exact") -> DataFrame:
    """(slices, lo, hi, method) of base rate less candidate rate under the same draws; positive: the candidate is better."""
    keys = list(slices)
    flat = pairs.select(*keys, F.col("pos").cast("long").alias("pos"), *[F.col(f"{side}.{c}").alias(f"{side[0]}{c[5]}") for side in ("base", "candidate") for c in ("char_edits", "char_ref_len")])
    sums = _resampled(flat, keys, ["be", "br", "ce", "cr"], resamples, seed, method)
    value = F.when((F.col("br") > 0) & (F.col("cr") > 0), F.col("be") / F.col("br") - F.col("ce") / F.col("cr"))
    return _interval(sums.withColumn("value", value), keys, alpha).withColumn("method", F.lit(method))


def bootstrap_both(pairs: DataFrame, *slices: str, resamples: int = RESAMPLES, seed: int = SEED, alpha: float = ALPHA, method: str = "exact") -> DataFrame:
    """(slices, ci_lo, ci_hi, baseline_ci_lo, baseline_ci_hi, delta_lo, delta_hi): the candidate's and the base's own
    intervals and the paired one, all from one round of draws, which both sides see alike."""
    keys = list(slices)
    flat = pairs.select(*keys, F.col("pos").cast("long").alias("pos"), *[F.col(f"{side}.{c}").alias(f"{side[0]}{c[5]}") for side in ("base", "candidate") for c in ("char_edits", "char_ref_len")])
    sums = _resampled(flat, keys, ["be", "br", "ce", "cr"], resamples, seed, method)
    own = lambda side: F.when(F.col(f"{side}r") > 0, F.col(f"{side}e") / F.col(f"{side}r"))
    values = {"ci": own("c"), "baseline_ci": own("b"), "delta": own("b") - own("c")}
    lists = sums.groupBy(*keys).agg(*[F.sort_array(F.collect_list(v)).alias(name) for name, v in values.items()])  # nulls are left out
    return lists.select(*keys, *[bound.alias(f"{name}_{end}") for name in values for end, bound in zip(("lo", "hi"), _bounds(F.col(name), F.size(name), alpha), strict=True)])


def verdict(lo: Column, hi: Column) -> Column:
    """An interval that touches zero decides nothing."""
    return F.when(lo > 0, "IMPROVED").when(hi < 0, "REGRESSED").when(lo.isNotNull() & hi.isNotNull(), "INCONCLUSIVE")


def select_lambda(rows: Iterable[dict], baseline_ood: float, budget: float, threshold: float) -> float:
    """The last row of a sweep, by lambda, before the budget or the elbow stops it.

    A row is over when its OOD rate passes baseline + budget. From the second accepted row on,
    the elbow is its OOD cost per validation gain (infinite without gain) against the last
    positive such ratio. Rows without an OOD rate take no part; none accepted is an error.
    """
    chosen = last_ratio = None
    for row in sorted((r for r in rows if r["ood_cer"] is not None), key=lambda r: r["lambda"]):
        if row["ood_cer"] > baseline_ood + budget:
            break
        if chosen is not None:
            gain = chosen["val_cer"] - row["val_cer"]
            ratio = (row["ood_cer"] - chosen["ood_cer"]) / gain if gain > 0 else math.inf
            if last_ratio is not None and ratio > threshold * last_ratio:
                break
            if ratio > 0:
                last_ratio = ratio
        chosen = row
    if chosen is None:
        raise ValueError("no row keeps within the budget")
    return chosen["lambda"]


def selected_lambdas(sweeps: DataFrame, *keys: str, baseline_ood: Column | float, budget: float, threshold: float, strict: bool = True) -> DataFrame:
    """(keys, lambda): `select_lambda` of every run of a table of sweeps, each a row's fold in the JVM. A run none of
    whose rows keeps within the budget is an error, or null without `strict`. baseline_ood: a number, or a column that
    every row of a run has alike."""
    base = baseline_ood if isinstance(baseline_ood, Column) else F.lit(float(baseline_ood))
    rows = sweeps.where(F.col("ood_cer").isNotNull()).select(*keys, F.struct(F.col("lambda").cast("double").alias("at"), F.col("val_cer").cast("double").alias("val"), F.col("ood_cer").cast("double").alias("ood"), (base + budget).cast("double").alias("most")).alias("_row"))
    runs = sweeps.select(*keys).distinct().join(rows.groupBy(*keys).agg(F.sort_array(F.collect_list("_row")).alias("_rows")), list(keys), "left") if keys else rows.agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    none = F.lit(None).cast("double")
    start = F.struct(none.alias("at"), none.alias("val"), none.alias("ood"), none.alias("ratio"), F.lit(False).alias("over"))

    def step(acc: Column, row: Column) -> Column:
        gain = acc["val"] - row["val"]
        ratio = F.when(gain > 0, (row["ood"] - acc["ood"]) / gain).otherwise(float("inf"))
        elbow = acc["at"].isNotNull() & acc["ratio"].isNotNull() & (ratio > threshold * acc["ratio"])
        last = F.when(acc["at"].isNotNull() & (ratio > 0), ratio).otherwise(acc["ratio"])
        taken = F.struct(row["at"].alias("at"), row["val"].alias("val"), row["ood"].alias("ood"), last.alias("ratio"), F.lit(False).alias("over"))
        ended = F.struct(acc["at"].alias("at"), acc["val"].alias("val"), acc["ood"].alias("ood"), acc["ratio"].alias("ratio"), F.lit(True).alias("over"))
        return F.when(acc["over"], acc).when((row["ood"] > row["most"]) | F.coalesce(elbow, F.lit(False)), ended).otherwise(taken)

    found = F.aggregate(F.coalesce("_rows", F.array().cast(runs.schema["_rows"].dataType)), start, step)["at"]
    if strict:
        found = F.coalesce(found, F.raise_error(F.lit("no row keeps within the budget")).cast("double"))
    return runs.select(*keys, found.alias("lambda"))


def curve_summary(curve: DataFrame, order: str, value: str, *keys: str, warmup_end: Column | None = None, blocks: int = 10, tail: int = 10) -> DataFrame:
    """Shape of each curve after warm-up: first, least and tail mean, share of rises between block means, divergence.

    Only rows after warmup_end count, or all where none is; `steps` counts all rows.
    """
    rows = curve.where(F.col(value).isNotNull()).select(*keys, F.col(order).alias("o"), F.col(value).alias("v"), (F.lit(True) if warmup_end is None else F.col(order) > warmup_end).alias("late"))
    whole = Window.partitionBy(*keys)
    rows = rows.withColumns({"any_late": F.max("late").over(whole), "steps": F.count("*").over(whole)}).where("late or not any_late")
    by = whole.orderBy("o")
    rows = rows.withColumns({"rn": F.row_number().over(by), "n": F.count("*").over(whole)})
    rows = rows.withColumn("block", F.floor((F.col("rn") - 1) / F.greatest(F.lit(1), F.floor(F.col("n") / blocks))))
    means = rows.groupBy(*keys, "block").agg(F.avg("v").alias("m"))
    rises = means.withColumn("up", (F.col("m") > F.lag("m").over(whole.orderBy("block"))).cast("int")).groupBy(*keys).agg((F.coalesce(F.sum("up"), F.lit(0)) / F.greatest(F.lit(1), F.count("*") - 1)).alias("rise_frac"))
    odd = F.isnan(F.col("v").cast("double")) | (F.col("v") == float("inf"))
    ends = rows.groupBy(*keys).agg(F.first("steps").alias("steps"), F.min_by("v", "rn").alias("first"), F.min("v").alias("least"), F.avg(F.when(F.col("rn") > F.col("n") - tail, F.col("v"))).alias("final"), F.max(odd).alias("odd"))
    joined = ends.join(rises, list(keys)) if keys else ends.crossJoin(rises)
    return joined.withColumn("diverged", F.col("odd") | (F.col("final") > F.col("first"))).drop("odd")


#: Columns of a probe's summary, one row for each learning rate that was tried.
PROBE_FIELDS = ("learning_rate", "steps", "warmup_end_step", "first_post_warmup_loss", "min_loss", "final_loss", "rise_frac", "diverged")


def probe_summary(logs: DataFrame, rate: str = "tried", blocks: int = 10) -> DataFrame:
    """PROBE_FIELDS of every tried rate, from the logs of all of them: the shape of its curve after its own warm-up.
    logs: (rate, step, loss, learning_rate), the last as it was scheduled."""
    ends = warmup_end(logs, rate)
    shape = curve_summary(logs.join(ends, rate), "step", "loss", rate, warmup_end=F.col("warmup_end"), blocks=blocks).join(ends, rate)
    named = [F.col(rate).alias("learning_rate"), "steps", F.col("warmup_end").alias("warmup_end_step"), F.round("first", 4).alias("first_post_warmup_loss"), F.round("least", 4).alias("min_loss"), F.round("final", 4).alias("final_loss"), F.round("rise_frac", 3).alias("rise_frac"), "diverged"]
    return shape.select(*named)


def block_means(curve: DataFrame, order: str, value: str, every: int, *keys: str) -> DataFrame:
    """(keys, last, mean) of each run of `every` rows, named by its last place."""
    by = Window.partitionBy(*keys).orderBy(order)
    rows = curve.withColumn("rn", F.row_number().over(by)).withColumn("block", F.floor((F.col("rn") - 1) / every))
    return rows.groupBy(*keys, "block").agg(F.max_by(order, "rn").alias("last"), F.avg(value).alias("mean")).drop("block")


def warmup_end(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, warmup_end): the first step with the highest learning rate; a log without any row is an error."""
    out = rows.groupBy(*keys).agg(F.max_by("step", F.struct(F.col("learning_rate"), -F.col("step"))).alias("warmup_end"))
    missing = F.raise_error(F.lit("the log has no loss rows")).cast("long")
    return out.withColumn("warmup_end", F.coalesce("warmup_end", missing))


def early_stop(curve: DataFrame, order: str, value: str, patience: int, *keys: str, greater_is_better: bool = False, block: int = 1 << 16) -> DataFrame:
    """(keys, stopped_at): where `patience` rows in a row have not beaten the best before them; null if never.

    Runs of up to `block` rows are sorted as wholes. If one is longer, rows get places and are cut into blocks. A block's best value, and the place
    of its last improvement, are summaries that combine by minimum and maximum, so prefix scans over the blocks tell
    each one what it starts with; the rest is decided inside it. Rows without a value beat nothing.
    """
    sign = -1 if greater_is_better else 1
    if not any_larger(curve, keys, block):
        by = Window.partitionBy(*keys).orderBy(order)
        best = F.min(sign * F.col(value)).over(by.rowsBetween(Window.unboundedPreceding, -1))
        rows = curve.withColumn("better", (sign * F.col(value) < best) | best.isNull()).withColumn("run", F.sum(F.col("better").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
        since = F.row_number().over(Window.partitionBy(*keys, "run").orderBy(order)) - 1
        return rows.withColumn("since", since).groupBy(*keys).agg(F.min(F.when(F.col("since") >= patience, F.col(order))).alias("stopped_at"))
    rows = in_order(curve.select(*keys, F.col(order).alias("_o"), (sign * F.col(value)).alias("_v")), keys, ["_o"]).withColumn("_block", F.floor(F.col("_place") / block))
    own, blocks = [*keys, "_block"], Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    best = rows.groupBy(*own).agg(F.min("_v").alias("_best")).withColumn("_enters", F.min("_best").over(blocks)).drop("_best")
    inside = Window.partitionBy(*own).orderBy("_place")
    met = rows.alias("l").join(best.alias("r"), same(own)).select("l.*", "_enters")
    before = F.least(F.col("_enters"), F.min("_v").over(inside.rowsBetween(Window.unboundedPreceding, -1)))  # passes over nulls
    better = (F.col("_v") < before) | (before.isNull())
    last = F.max(F.when(better, F.col("_place"))).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    judged = met.withColumn("_last", last)
    # within a block only the first row that has waited long enough matters, and that depends on what the block starts with
    waits = judged.groupBy(*own).agg(F.max("_last").alias("_block_last")).withColumn("_came", F.max("_block_last").over(blocks)).drop("_block_last")
    since = F.col("_place") - F.greatest("_last", "_came")
    return judged.alias("l").join(waits.alias("r"), same(own)).groupBy(*[F.col(f"l.`{k}`") for k in keys]).agg(F.min(F.when(since >= patience, F.col("_o"))).alias("stopped_at"))
