"""Streams whose rows come late and out of order, over several micro-batches and restarts; a sink that repeats nothing."""

import random

import pytest
from pyspark.sql import functions as F

from lectern import streaming
from lectern.operators import stats


def feed(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros(((F.col("at") + 86400) * 1_000_000).cast("long"))).coalesce(1).write.mode("append").parquet(path)


def through(spark, tmp_path, rows, schema, build, seed, far):
    """The rows in eight files, each row up to 30 seconds of event time late, read one by one with a stop after each."""
    rng = random.Random(seed)
    arriving = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 30))
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    size = -(-len(arriving) // 8)
    parts = [arriving[i : i + size] for i in range(0, len(arriving), size)] + [[far]]
    for i in range(0, len(parts), 3):
        for part in parts[i : i + 3]:
            feed(spark, path, part, schema)
        full = spark.read.parquet(path).schema
        done = streaming.drained(build(spark.readStream.schema(full).option("maxFilesPerTrigger", 1).parquet(path)), out)
    return done.collect()


def folded(starts, end, min_gap=2.0, longest=30.0, shortest=15.0):
    out, last, before = [], 0.0, None
    for t in sorted(starts):
        if before is not None and t - before >= min_gap:
            at = (t + before) / 2
            if at - last > longest:
                last += longest
                out.append(last)
            elif at - last >= shortest:
                last = at
                out.append(last)
        before = t
    while end - last > longest:
        last += longest
        out.append(last)
    return out


def test_greedy_cuts_of_words_out_of_order(spark, tmp_path):
    rng = random.Random(1)
    rows, want = [], {}
    for key in ("a", "b", "c"):
        starts = sorted({round(rng.uniform(0, 400), 3) for _ in range(70)})
        rows += [(key, t, t if t == starts[-1] else None) for t in starts]
        want[key] = folded(starts, starts[-1])
    got = through(spark, tmp_path, rows, "key string, at double, duration double", lambda s: streaming.greedy_cuts(s.withColumn("start", F.col("at")), "key", 2.0, 30.0, 15.0, late="40 seconds"), 2, ("", 1e9, None))
    found = {}
    for r in got:
        found.setdefault(r.key, []).append(r.cut)
    assert {k: sorted(v) for k, v in found.items()} == want


def test_early_stops_of_rows_out_of_order(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"r{k}", float(i), float(rng.randrange(5 + 20 * k))) for k in range(5) for i in range(80)]
    got = through(spark, tmp_path, rows, "key string, at double, v double", lambda s: streaming.early_stops(s.withColumn("step", F.col("at").cast("long")), "key", "step", "v", 9, late="40 seconds"), 4, ("", 1e9, 0.0))
    frame = spark.createDataFrame(rows, "key string, step double, v double")
    want = {r.key: int(r.stopped_at) for r in stats.early_stop(frame, "step", "v", 9, "key").collect() if r.stopped_at is not None}
    assert {r.key: r.stopped_at for r in got if r.key} == want and len(got) == len({r.key for r in got})


def test_a_crash_between_write_and_commit_repeats_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "sink")
    rows = lambda low, high: spark.createDataFrame([(i, f"d{i}") for i in range(low, high)], "id long, sha string")
    read = lambda: sorted((r.id, r.sha) for r in streaming.appended(spark, path, "id long, sha string").collect())
    assert read() == []
    streaming.append_new(rows(0, 20), path, "id", "sha", batch_id=0)

    def crash(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(streaming, "_commit", crash)
        with pytest.raises(OSError, match="lost"):
            streaming.append_new(rows(10, 40), path, "id", "sha", batch_id=1)
    assert read() == [(i, f"d{i}") for i in range(20)]  # what was written is not seen
    streaming.append_new(rows(10, 40), path, "id", "sha", batch_id=1)
    streaming.append_new(rows(10, 40), path, "id", "sha", batch_id=1)  # seen again as a whole
    streaming.append_new(rows(5, 30), path, "id", "sha")  # and in another batch
    assert read() == [(i, f"d{i}") for i in range(40)]
    with pytest.raises(Exception, match="changed content"):
        streaming.append_new(spark.createDataFrame([(3, "other")], "id long, sha string"), path, "id", "sha")
    with pytest.raises(Exception, match="changed content"):
        streaming.append_new(spark.createDataFrame([(90, "x"), (90, "y")], "id long, sha string"), path, "id", "sha")
    assert read() == [(i, f"d{i}") for i in range(40)]


def test_a_batch_reads_its_own_buckets_only(spark, tmp_path):
    path = tmp_path / "sink"
    rows = spark.range(200).select("id", F.concat(F.lit("d"), "id").alias("sha"))
    streaming.append_new(rows, str(path), "id", "sha", buckets=16)
    bucket = F.pmod(F.xxhash64("id"), F.lit(16))
    for other in path.glob("v*/bucket=*"):
        if other.name != "bucket=5":
            for f in [*other.glob("*.parquet"), *other.glob(".*.crc")]:
                f.unlink()
    again = rows.where(bucket == 5)
    streaming.append_new(again.union(spark.range(1000, 1400).select("id", F.lit("n").alias("sha")).where(bucket == 5)), str(path), "id", "sha", buckets=16)
    left = [p for p in path.glob("v*/bucket=5")]
    assert len(left) == 2 and spark.read.parquet(*map(str, left)).count() == again.count() + spark.range(1000, 1400).where(bucket == 5).count()


def test_keys_share_states_and_long_recordings_are_runs(spark, tmp_path):
    """However many keys there are, so many states; a recording's forced cuts are few rows until they are wanted."""
    rows = [(f"k{i}" if i else None, float(t), 300_001.0 if t == 300 else None) for i in range(300) for t in (0, 20, 300)]
    feed(spark, str(tmp_path / "in"), rows, "key string, at double, duration double")
    feed(spark, str(tmp_path / "in"), [("", 1e9, None)], "key string, at double, duration double")
    full = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(full).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("start", F.col("at"))
    runs = streaming.greedy_cut_runs(stream, "key", 2.0, 30.0, 15.0, late="40 seconds")
    query = runs.writeStream.format("memory").queryName("runs_of_cuts").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert 0 < max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]) <= streaming.BUCKETS
    found = spark.table("runs_of_cuts")
    assert found.count() < 300 * 10
    cuts = streaming.cuts_of_runs(found, 30.0).groupBy("key").agg(F.sort_array(F.collect_list("cut")).alias("cuts")).collect()
    want = folded([0.0, 20.0, 300.0], 300_001.0)
    assert {r.key for r in cuts} == {None, *(f"k{i}" for i in range(1, 300))} and all(r.cuts == want for r in cuts)


def test_runs_of_cuts_are_the_same_numbers():
    import numpy as np

    for last, step in ((0.1, 0.1), (47.123, 30.0), (0.0, 1 / 3)):
        sums = np.cumsum(np.concatenate([[last], np.full(500, step)]))[1:]
        assert [first + i * step for first, n in streaming._stepped(sums, step) for i in range(n)] == sums.tolist()


def test_values_that_are_missing_stop_nothing(spark, tmp_path):
    rows = [("a", 0.0, None), ("a", 1.0, None), ("a", 2.0, 5.0), ("a", 3.0, None), ("a", 4.0, 6.0), ("a", 5.0, 7.0), ("b", 0.0, 1.0), ("b", 1.0, 0.5)]
    got = through(spark, tmp_path, rows, "key string, at double, v double", lambda s: streaming.early_stops(s.withColumn("step", F.col("at").cast("long")), "key", "step", "v", 3, late="40 seconds"), 5, ("", 1e9, 0.0))
    assert {r.key: r.stopped_at for r in got} == {"a": 5}
