"""Streaming forms of timeline and training operators."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucket_counts(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes", *keys: str) -> DataFrame:
    """Tumbling counts and sums with a watermark; on a batch frame the same rows at once."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def pause_sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of events without a pause of `gap`."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


#: A row that waits for the watermark: the place of its key in the state, event time in microseconds, and what the fold takes.
_WAITING = np.dtype([("key", "<i8"), ("us", "<i8"), ("a", "<f8"), ("b", "<f8")])
#: Groups of keys that share a state and a call of Python. A stream keeps the number that it began with.
BUCKETS = 128
#: Forced cuts that one run of them holds at most.
RUN = 1 << 12


def _packed(keys: np.ndarray) -> bytes:
    """Texts, nulls among them, as bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("key", pa.string())])) as out:
        out.write_table(pa.table({"key": pa.array(keys, pa.string())}))
    return sink.getvalue().to_pybytes()


def _in_event_order(rows: DataFrame, late: str, fold: Callable, start: tuple, out: str, buckets: int = BUCKETS) -> DataFrame:
    """fold over each key's rows in the order of their event times, however they arrive within `late`.

    rows: (key, ts, a, b). Rows wait in the state until the watermark has passed them; then nothing earlier can come, and
    fold(states, owners, a, b) -> (owners, *columns of results, ended) takes them at once: states is an array with a row
    for each key, which it updates; owners is each row's key by its place there, ascending, and rows of a key follow in
    order; ended says of each key whether it gives up its state. Keys are dealt into `buckets` by their hash, and a
    bucket's are folded in one call, as a call for each key costs far more than its rows. A timer wakes a bucket whose
    rows wait although no new one arrives.
    """
    names = [c.split(" ")[0] for c in out.split(", ")]

    def step(_: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        keys, kept, held = np.zeros(0, dtype=object), np.zeros((0, len(start))), np.zeros(0, dtype=_WAITING)
        if state.exists:
            raw, states, waiting = state.get
            keys = pa.ipc.open_stream(raw).read_all().column("key").to_numpy()
            kept, held = np.frombuffer(states).reshape(-1, len(start)), np.frombuffer(waiting, dtype=_WAITING)
        known = len(keys)
        if not state.hasTimedOut:
            new = pd.concat(list(frames))
            came = np.zeros(len(new), dtype=_WAITING)
            places, keys = pd.factorize(np.concatenate([keys, new["key"].to_numpy(dtype=object)]), use_na_sentinel=False)
            keys[pd.isna(keys)] = None
            came["key"], came["us"], came["a"], came["b"] = places[known:], new["us"], new["a"], new["b"]
            held = np.concatenate([held, came])
            held = held[np.lexsort((held["a"], held["us"], held["key"]))]
        kept = np.concatenate([kept, np.tile(np.array(start, dtype=float), (len(keys) - known, 1))])
        passed = held["us"] <= state.getCurrentWatermarkMs() * 1000
        own = held[passed]
        owners, *found, ended = fold(kept, own["key"], own["a"], own["b"])
        waiting = held[~passed]
        waiting = waiting[~ended[waiting["key"]]]
        waiting["key"] = (np.cumsum(~ended) - 1)[waiting["key"]]
        if ended.all():
            state.remove()
        else:
            state.update((_packed(keys[~ended]), kept[~ended].tobytes(), waiting.tobytes()))
            if len(waiting):
                state.setTimeoutTimestamp(int(max(-(-int(waiting["us"].min()) // 1000), state.getCurrentWatermarkMs() + 1)))
        if len(owners):
            yield pd.DataFrame({"key": keys[owners], **dict(zip(names, found, strict=True))})

    timed = rows.withWatermark("ts", late).select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "key", "ts", F.unix_micros("ts").alias("us"), "a", "b")
    return timed.groupBy("bucket").applyInPandasWithState(step, f"key string, {out}", "keys binary, states binary, waiting binary", "append", "EventTimeTimeout")


def _ends(owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are the first, and which the last, of their key."""
    differs = owners[1:] != owners[:-1]
    edge = np.ones(min(1, len(owners)), dtype=bool)
    return np.concatenate([edge, differs]), np.concatenate([differs, edge])


def _stepped(cuts: np.ndarray, step: float) -> Iterator[tuple[float, int]]:
    """Cuts of one step, as sums tell them, by runs (first, n) whose places first + i * step are the same numbers."""
    while len(cuts):
        off = np.flatnonzero(cuts != cuts[0] + step * np.arange(len(cuts)))
        n = int(off[0]) if len(off) else len(cuts)
        yield float(cuts[0]), n
        cuts = cuts[n:]


def greedy_cut_runs(words: DataFrame, key: str, min_gap: float, longest: float, shortest: float, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """(key, first, n): the greedy cuts of each recording as its words arrive, up to `late` out of order, by runs of up to
    RUN cuts that follow each other at `longest`.

    words: (key, start, duration, ts), ts being the start as a time; a row with a duration ends its recording and brings
    the forced cuts up to it. The state of a recording is its last start, its last cut and the words that wait.
    """

    def fold(kept: np.ndarray, owners: np.ndarray, starts: np.ndarray, durations: np.ndarray) -> tuple:
        first, final = _ends(owners)
        previous = np.concatenate([starts[:0], [np.nan], starts[:-1]])[: len(starts)]
        previous[first] = kept[owners[first], 0]
        with np.errstate(invalid="ignore"):
            gaps = np.flatnonzero((starts - previous >= min_gap) | ~np.isnan(durations))
        runs: list[tuple[int, float, int]] = []
        lasts, steps = kept[:, 1].tolist(), np.full(RUN, longest)
        for owner, start, before, duration in zip(*(x[gaps].tolist() for x in (owners, starts, previous, durations)), strict=True):
            last = lasts[owner]
            if start - before >= min_gap:
                at = (start + before) / 2
                if at - last > longest:
                    last += longest
                    runs.append((owner, last, 1))
                elif at - last >= shortest:
                    last = at
                    runs.append((owner, last, 1))
            while duration - last > longest:
                sums = np.cumsum(np.concatenate([[last], steps]))
                n = int((duration - sums[:-1] > longest).sum())
                runs += [(owner, *run) for run in _stepped(sums[1 : n + 1], longest)]
                last = float(sums[n])
            lasts[owner] = last
        kept[:, 1] = lasts
        kept[owners[final], 0] = starts[final]
        ended = np.zeros(len(kept), dtype=bool)
        ended[owners[final]] = ~np.isnan(durations[final])
        own, firsts, counts = zip(*runs, strict=True) if runs else ((), (), ())
        return np.array(own, dtype=np.int64), firsts, counts, ended

    narrow = words.select(F.col(key).cast("string").alias("key"), "ts", F.col("start").cast("double").alias("a"), F.col("duration").cast("double").alias("b"))
    return _in_event_order(narrow, late, fold, (float("nan"), 0.0), "first double, n long", buckets)


def cuts_of_runs(runs: DataFrame, longest: float) -> DataFrame:
    """(key, cut) of `greedy_cut_runs`."""
    return runs.select("key", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")).select("key", (F.col("first") + F.col("i") * longest).alias("cut"))


def greedy_cuts(words: DataFrame, key: str, min_gap: float, longest: float, shortest: float, late: str = "10 minutes") -> DataFrame:
    """(key, cut): `greedy_cut_runs`, a row for each cut."""
    return cuts_of_runs(greedy_cut_runs(words, key, min_gap, longest, shortest, late), longest)


def early_stops(curve: DataFrame, key: str, order: str, value: str, patience: int, greater_is_better: bool = False, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """(key, stopped_at): the point where `patience` rows in a row have not beaten the best, once for each run, as
    soon as the watermark has passed it. curve has a time column ts in the order of `order`. The state of a run is its
    best value, the rounds since, whether it has stopped, and the rows that wait. Rows without a value beat nothing."""
    sign = -1.0 if greater_is_better else 1.0

    def fold(kept: np.ndarray, owners: np.ndarray, places: np.ndarray, values: np.ndarray) -> tuple:
        found, at = [], []
        best, rounds, done = (kept[:, i].tolist() for i in range(3))  # no best yet: NaN
        for owner, place, own in zip(owners.tolist(), places.tolist(), (sign * values).tolist(), strict=True):
            if done[owner]:
                continue
            so_far = best[owner]
            if own < so_far or so_far != so_far:
                best[owner], rounds[owner] = own, 0.0
                continue
            rounds[owner] += 1
            if rounds[owner] >= patience:
                done[owner] = 1.0
                found.append(owner)
                at.append(int(place))
        kept[:] = np.array([best, rounds, done]).T
        return np.array(found, dtype=np.int64), at, np.zeros(len(kept), dtype=bool)

    narrow = curve.select(F.col(key).cast("string").alias("key"), "ts", F.col(order).cast("double").alias("a"), F.col(value).cast("double").alias("b"))
    return _in_event_order(narrow, late, fold, (float("nan"), 0.0, 0.0), "stopped_at long", buckets)


def drained(stream: DataFrame, path: str) -> DataFrame:
    """Whatever the source has by now, written below path, and all rows written so far. A later call with the same path
    goes on where the last one ended: its checkpoint is the stage's state."""
    stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def _committed(spark, path: str) -> list[dict]:
    """The versions of a sink, a row for each batch: {"folder": name, "buckets": [...]}."""
    log = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    if not log.getFileSystem(spark._jsc.hadoopConfiguration()).exists(log):
        return []
    return [json.loads(r[0]) for r in spark.read.text(f"{path}/versions").collect()]


def _commit(spark, path: str, version: dict) -> None:
    """The version becomes visible by one rename, or not at all."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    log, draft = Path(f"{path}/versions"), Path(f"{path}/drafts/{version['folder']}")
    files = log.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(log)
    out = files.create(draft, True)
    out.write(bytearray((json.dumps(version) + "\n").encode()))
    out.close()
    if not files.rename(draft, Path(f"{path}/versions/{version['folder']}.json")):
        raise OSError(f"cannot commit {version['folder']} of {path}")


def appended(spark, path: str, schema) -> DataFrame:
    """The rows of a sink's committed versions."""
    folders = [f"{path}/{v['folder']}/bucket={b}" for v in _committed(spark, path) for b in v["buckets"]]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def append_new(batch: DataFrame, path: str, key: str, digest: str, batch_id: int | None = None, buckets: int = 256) -> None:
    """foreachBatch sink that may see a row twice, in one batch or in several: a known key with the same digest is passed
    over, with another one it fails.

    A batch writes its new rows into a folder of its own, by buckets of the key's hash, and then commits it to the
    sink's list of versions. Of what is there it reads keys and digests of its own keys' buckets only, in committed
    versions. What a crash leaves between write and commit is never read; run again, the batch writes it anew. With
    batch_id, the number that Spark gives a batch, one that has been committed is passed over as a whole.
    """
    spark = batch.sparkSession
    known = _committed(spark, path)
    folder = f"v{uuid.uuid4().hex}" if batch_id is None else f"b{batch_id}"
    if any(v["folder"] == folder for v in known):
        return
    changed = F.raise_error(F.concat(F.lit("changed content of "), F.col(key).cast("string"))).cast("string")
    whole = F.struct(*batch.columns)
    once = batch.groupBy(key).agg(F.min_by(whole, F.col(digest)).alias("_row"), F.min(digest).alias("_low"), F.max(digest).alias("_high"))
    once = once.withColumn("_known", F.when(F.col("_low") != F.col("_high"), changed)).where("_known is null").select("_row.*")
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    own = {r[0] for r in batch.select(bucket.alias("b")).distinct().collect()} if known else set()  # `buckets` at most
    there = [f"{path}/{v['folder']}/bucket={b}" for v in known for b in v["buckets"] if b in own]
    if there:
        old = spark.read.schema(batch.schema).parquet(*there)
        once = once.join(old.select(key, F.col(digest).alias("_known")), key, "left")
        wrong = F.when(F.col("_known") != F.col(digest), changed)
        once = once.withColumn("_known", F.coalesce(wrong, F.col("_known"))).where("_known is null").select(*batch.columns)
    once.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{folder}")
    written = spark.read.schema(f"`{key}` string, bucket int").parquet(f"{path}/{folder}").select("bucket").distinct().collect()
    _commit(spark, path, {"folder": folder, "buckets": sorted(r[0] for r in written)})
