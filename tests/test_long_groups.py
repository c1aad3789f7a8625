"""Percentiles, cuts and early stops of one group over many tasks, equal to the plain folds."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import ranks, stats, timeline


def test_sortable_bits(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, math.inf, -math.inf]
    values += [math.nextafter(2.0**e, to) for e in range(-1070, 1023, 7) for to in (0, math.inf)] + [2.0**e for e in range(-1074, 1024, 5)]
    values += [struct.unpack("d", rng.randbytes(8))[0] for _ in range(3000)]
    values = [v for v in values if not math.isnan(v)]
    frame = spark.createDataFrame([(v,) for v in values], "v double").select("v", ranks.sortable(F.col("v")).alias("b"))
    bits = lambda v: struct.unpack("q", struct.pack("d", abs(v)))[0] * (-1 if v < 0 else 1)
    assert all(r.b == bits(r.v) for r in frame.collect())


@pytest.mark.parametrize("share", [0.15, 0.999, 1.0])
def test_percentiles_equal_numpy_at_any_size(spark, share):
    rng = np.random.default_rng(2)
    groups = {"a": rng.standard_normal(3001), "b": np.repeat([1.5, 2.5, -7.0], 1000), "c": rng.standard_normal(64) * 1e300, "d": np.array([4.0]), None: np.exp(rng.standard_normal(900) * 40) * rng.choice([-1, 1], 900)}
    rows = [(k, float(v)) for k, values in groups.items() for v in values] + [("a", None), ("none", None)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(7)
    want = {k: float(np.quantile(v, share)) for k, v in groups.items()}
    for small in (1 << 14, 64):
        assert {r.k: r.level for r in ranks.percentiles(frame, ["k"], "v", share, small=small).collect()} == want
    assert ranks.percentiles(frame, [], "v", share, small=10).first().level == float(np.quantile(np.concatenate(list(groups.values())), share))
    assert ranks.percentiles(frame.limit(0), ["k"], "v", share).count() == 0


def test_percentile_of_a_large_key(spark):
    n = 400_000
    frame = spark.range(n).select(F.lit("k").alias("k"), (F.xxhash64("id") / F.lit(2.0**40)).alias("v"))
    values = np.array([r.v for r in frame.select("v").collect()])
    assert ranks.percentiles(frame, ["k"], "v", 0.15).first().level == float(np.percentile(values, 15))


def folded(at, duration, longest=30.0, shortest=15.0):
    out, last = [], 0.0
    for t in sorted(at):
        if t - last > longest:
            last += longest
            out.append(last)
        elif t - last >= shortest:
            last = t
            out.append(last)
    more = max(0, math.ceil((duration - last) / longest) - 1)
    return out + [last + k * longest for k in range(1, more + 1)]


def cut_rows(spark, recordings, block):
    candidates = spark.createDataFrame([(k, float(t)) for k, (at, _) in recordings.items() for t in at], "k string, at double").repartition(5)
    durations = spark.createDataFrame([(k, float(d)) for k, (_, d) in recordings.items()], "k string, duration double")
    out = {}
    for r in sorted(timeline.greedy_cut_rows(candidates, durations, "k", block=block).collect(), key=lambda r: (r.k, r.i)):
        out.setdefault(r.k, []).append(r.cut)
        assert r.i == len(out[r.k]) - 1
    return out


@pytest.mark.parametrize("block", [3, 64, 1 << 16])
def test_cuts_in_blocks_equal_the_fold(spark, block):
    rng = random.Random(block)
    recordings = {"none": ([], 95.0), "short": ([1, 16, 20], 21.0), "gap": ([16, 5000, 5001, 5002, 5003, 5050, 5080], 5100.0), "even": ([15.0 * i for i in range(40)], 600.0), "tie": ([20.0] * 5 + [36.0] * 3, 40.0)}
    recordings |= {f"r{i}": ([rng.uniform(0, 3000) for _ in range(rng.randrange(10, 400))], rng.uniform(2000, 4000)) for i in range(6)}
    assert cut_rows(spark, recordings, block) == {k: c for k, (at, d) in recordings.items() if (c := folded(at, d))}


def test_cuts_of_a_long_recording(spark):
    n = 1_000_000
    frame = spark.range(n).select(F.lit("k").alias("k"), (F.col("id") + F.pmod(F.xxhash64("id"), F.lit(1000)) / 1001.0).alias("at"))
    durations = spark.createDataFrame([("k", n + 100.0)], "k string, duration double")
    got = [r.cut for r in sorted(timeline.greedy_cut_rows(frame, durations, "k", block=1 << 14).collect(), key=lambda r: r.i)]
    assert got == folded([r.at for r in frame.select("at").collect()], n + 100.0)


def stops(values, patience, sign=1):
    best, since = None, 0
    for place, v in enumerate(values):
        if best is None or sign * v < sign * best:
            best, since = v, 0
        else:
            since += 1
        if since >= patience:
            return place
    return None


@pytest.mark.parametrize("block", [1, 5, 1 << 16])
@pytest.mark.parametrize("greater", [False, True])
def test_early_stops_in_blocks_equal_the_fold(spark, block, greater):
    rng = random.Random(block)
    runs = {f"r{i}": [rng.randrange(4 + i * 9) for _ in range(rng.randrange(1, 90))] for i in range(12)} | {"down": list(range(60, 0, -1)), "flat": [1] * 30}
    frame = spark.createDataFrame([(k, i, float(v)) for k, vs in runs.items() for i, v in enumerate(vs)], "k string, step long, v double").repartition(3)
    got = {r.k: r.stopped_at for r in stats.early_stop(frame, "step", "v", 6, "k", greater_is_better=greater, block=block).collect()}
    assert got == {k: stops(vs, 6, -1 if greater else 1) for k, vs in runs.items()}


def test_early_stop_of_one_long_run(spark):
    n = 300_000
    frame = spark.range(n).select(F.col("id").alias("step"), F.when(F.col("id") < 200_000, -F.floor(F.col("id") / 900)).otherwise(F.lit(0)).cast("double").alias("v"))
    assert stats.early_stop(frame, "step", "v", 899, block=1000).first().stopped_at == 899
    assert stats.early_stop(frame, "step", "v", 5000, block=1000).first().stopped_at == stops([-(i // 900) if i < 200_000 else 0 for i in range(n)], 5000)
    text = stats.early_stop(frame.withColumn("k", F.lit(1)), "step", "v", 5000, "k", block=1000)._jdf.queryExecution().executedPlan().toString()
    assert all("_block" in line for line in text.splitlines() if "Window" in line and "_v" in line)  # rows are windowed by block only


def test_large_groups_are_never_shuffled_by_group(spark, monkeypatch):
    """What is stored on the way to a percentile lies over as many tasks as the rows did, however few the groups."""
    plans = []

    def noted(frame, name):
        plans.append((name, frame._jdf.queryExecution().executedPlan().toString()))
        return stored(frame, name)

    stored = ranks.stored
    monkeypatch.setattr(ranks, "stored", noted)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(4000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v"))
        got = {r.g: r.level for r in ranks.percentiles(rows, ["g"], "v", 0.5, small=100).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {0: 1999.0, 1: 2000.0}
    found = [plan for name, plan in plans if name == "sortable"]
    assert found and "Exchange" not in found[0].replace("BroadcastExchange", "") and all("SortMergeJoin" not in plan for plan in found)


def test_poisson_weights_by_bounds_are_those_of_the_distribution():
    """Weights by blocks and integer bounds are those of a search in the distribution, as floats that multiply as a matrix."""
    pos = np.arange(10**9, 10**9 + 70)
    x = pos.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, 301, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(42)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)
    got = stats._poisson(pos, 300, 42)
    assert got.dtype == float and (got == np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(n) for n in range(16)]), u)).all()
    assert stats._poisson(pos[:0], 300, 42).shape == (0, 300)
