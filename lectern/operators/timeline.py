"""Words on a timeline: parsing, ends, gaps, cuts, segments, buckets, silence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators.places import any_larger, in_order
from lectern.operators.ranks import percentiles
from lectern.sources.layout import stored

MIN_GAP, MAX_SEGMENT, MIN_SEGMENT = 0.3, 30.0, 15.0
BUCKET_SECONDS, MIN_BUCKET_SECONDS, COLLAPSE = 300.0, 60.0, 0.7
MIDDLE_SECONDS = 1800.0
#: Candidates of a recording that are folded in one go.
CUT_BLOCK = 1 << 16


def infer_end(words: DataFrame, key: str) -> DataFrame:
    """A word ends where the next starts, but not after its display end nor before its own start."""
    following = F.lead("start").over(Window.partitionBy(key).orderBy("ord"))
    # least() passes over nulls, which is the rule for a last word and for a missing display end
    return words.withColumn("end", F.greatest("start", F.least(following, F.col("display_end"))))


def _finish(words: DataFrame, docs: DataFrame, key: str, fault: str) -> DataFrame:
    """Words with ends, errors as rows of their own raised: a document without any word is one."""
    ended = infer_end(words, key).withColumn("there", F.lit(True))
    out = docs.select(key).join(ended, key, "left")
    text = F.when(F.col("there").isNull(), F.raise_error(F.concat(F.lit(f"{fault}: "), F.col(key).cast("string"))).cast("string")).otherwise(F.col("text"))
    return out.withColumn("text", text).drop("display_end", "there")


def words_of_events(docs: DataFrame, key: str) -> DataFrame:
    """(key, ord, text, start, end) of caption documents with timed events; blank pieces and untimed events drop out.

    A document without a word is an error, and so is one none of whose pieces has an offset: it has no word timing.
    """
    pieces = docs.select(key, F.posexplode("events").alias("e", "event")).where("event.tStartMs is not null").select(key, "e", "event", F.posexplode("event.segs").alias("s", "seg"))
    pieces = pieces.select(
        key, F.struct("e", "s").alias("ord"), tx.strip(F.col("seg.utf8")).alias("text"),
        ((F.col("event.tStartMs") + F.coalesce("seg.tOffsetMs", F.lit(0))) / 1000).alias("start"),
        ((F.col("event.tStartMs") + F.col("event.dDurationMs")) / 1000).alias("display_end"), F.col("seg.tOffsetMs").alias("offset"),
    ).where("text <> ''")
    timed = F.max(F.col("offset").isNotNull()).over(Window.partitionBy(key))
    pieces = pieces.withColumn("text", F.when(timed, F.col("text")).otherwise(F.raise_error(F.lit("no word-level timing")).cast("string")))
    pieces = pieces.withColumn("ord", (F.row_number().over(Window.partitionBy(key).orderBy("ord")) - 1).cast("long"))
    return _finish(pieces.drop("offset"), docs, key, "no caption words in")


def words_of_entries(docs: DataFrame, key: str) -> DataFrame:
    """(key, ord, text, speaker, start, end) of documents with a word list; entries of another type drop out. A word
    without times is an error, and so is a document without words. Ends are clipped to the next start."""
    entries = docs.select(key, F.posexplode("words").alias("ord", "w")).where("w.type is null or w.type = 'word'").withColumn("said", tx.strip(F.col("w.text"))).where("said <> ''")
    timed = F.col("w.start").isNotNull() & F.col("w.end").isNotNull()
    text = F.when(timed, F.col("said")).otherwise(F.raise_error(F.lit("a word has no timing")).cast("string"))
    words = entries.select(key, F.col("ord").cast("long").alias("ord"), text.alias("text"), F.col("w.speaker_id").alias("speaker"), F.col("w.start").alias("start"), F.col("w.end").alias("display_end"))
    return _finish(words, docs, key, "no words in")


def timing_counts(docs: DataFrame, key: str) -> DataFrame:
    """(key, events, pieces, timed_pieces) of caption documents; a piece is timed if it has an offset."""
    none = F.array().cast("array<struct<utf8: string, tOffsetMs: bigint, acAsrConf: bigint>>")
    pieces = F.flatten(F.transform(F.coalesce("events", F.array()), lambda e: F.coalesce(e["segs"], none)))
    timed = F.filter(pieces, lambda p: p["tOffsetMs"].isNotNull())
    return docs.select(key, F.coalesce(F.size("events"), F.lit(0)).alias("events"), F.size(pieces).alias("pieces"), F.size(timed).alias("timed_pieces"))


#: Parser of each draft format.
PARSERS = {"json3": words_of_events, "scribe": words_of_entries}


def parse(docs: DataFrame, kind: str, key: str) -> DataFrame:
    if kind not in PARSERS:
        raise ValueError(f"no parser for {kind!r}; there are {sorted(PARSERS)}")
    return PARSERS[kind](docs, key)


def drop_labels(words: DataFrame) -> DataFrame:
    return words.where(~tx.is_label(F.col("text")))


def gap_candidates(words: DataFrame, key: str, min_gap: float = MIN_GAP) -> DataFrame:
    """(key, at): midpoints between starts at least min_gap apart."""
    before = F.lag("start").over(Window.partitionBy(key).orderBy("ord"))
    return words.withColumn("before", before).where(F.col("start") - F.col("before") >= min_gap).select(key, ((F.col("start") + F.col("before")) / 2).alias("at"))


def greedy_cuts(candidates: Column, duration: Column, longest: float = MAX_SEGMENT, shortest: float = MIN_SEGMENT) -> Column:
    """Cut times of one recording from its sorted candidate array.

    A candidate more than `longest` after the last cut forces a cut there and is itself lost;
    one at least `shortest` after it is a cut; after the last, cuts are forced to the end.
    """
    start = F.struct(F.array().cast("array<double>").alias("cuts"), F.lit(0.0).alias("last"))

    def step(acc: Column, at: Column) -> Column:
        put = lambda t: F.struct(F.array_append(acc["cuts"], t).alias("cuts"), t.alias("last"))
        return F.when(at - acc["last"] > longest, put(acc["last"] + longest)).when(at - acc["last"] >= shortest, put(at)).otherwise(acc)

    def finish(acc: Column) -> Column:
        more = F.greatest(F.lit(0), F.ceil((duration - acc["last"]) / longest) - 1).cast("int")
        tail = F.when(more > 0, F.transform(F.sequence(F.lit(1), F.greatest(more, F.lit(1))), lambda i: acc["last"] + i * longest)).otherwise(F.array().cast("array<double>"))
        return F.concat(acc["cuts"], tail)

    return F.aggregate(candidates, start, step, finish)


def _folded(at: np.ndarray, last: float, longest: float, shortest: float) -> tuple[list[float], float]:
    """The cuts that a block of sorted candidates makes after a cut at `last`, and the last cut then."""
    cuts, i, n = [], 0, len(at)
    while i < n:
        # candidates too near the last cut are passed over
        i = int(np.searchsorted(at, last + shortest, "left")) if at[i] - last < shortest else i
        while i < n and at[i] - last < shortest:  # the sum may round down
            i += 1
        if i >= n:
            break
        last = last + longest if at[i] - last > longest else float(at[i])
        cuts.append(last)
        i += 1
    return cuts, last


def greedy_cut_rows(candidates: DataFrame, durations: DataFrame, key: str, longest: float = MAX_SEGMENT, shortest: float = MIN_SEGMENT, block: int = CUT_BLOCK) -> DataFrame:
    """(key, i, cut): the cuts of `greedy_cuts` as rows, of recordings of any length. candidates: (key, at).

    If no recording has more candidates than a block, each is one array. Otherwise candidates get places and lie in blocks
    of so many, one row each. All blocks are folded at once, each from a guess of the cut that it starts with: its first
    candidate. Then those whose start was another one are folded again from the cut that the block before them ended with,
    until each started where its predecessor ended. Cuts soon fall on the same candidates whatever the start, so a round or
    two do; where candidates are so dense that they don't, every round walks over four times as many blocks in a row as the
    one before, block by block in one task's stream, so that there are as many rounds as the logarithm of the blocks.
    """
    candidates = candidates.select(key, F.col("at").cast("double").alias("_t")).where("_t is not null")
    if not any_larger(candidates, [key], block):
        arrays = candidates.groupBy(key).agg(F.sort_array(F.collect_list("_t")).alias("_at"))
        found = greedy_cuts(F.coalesce("_at", F.array().cast("array<double>")), F.col("duration"), longest, shortest)
        return durations.select(key, "duration").join(arrays, key, "left").select(key, F.posexplode(found).alias("i", "cut")).withColumn("i", F.col("i").cast("long"))
    rows = in_order(candidates, [key], ["_t"]).withColumn("_block", F.floor(F.col("_place") / block))
    kind = rows.schema[key].dataType.simpleString()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [pdf[key].iloc[0]], "_block": [pdf["_block"].iloc[0]], "_at": [np.sort(pdf["_t"].to_numpy(dtype="<f8")).tobytes()], "_first": [float(pdf["_t"].min())]})

    packed = stored(rows.groupBy(key, "_block").applyInPandas(pack, f"`{key}` {kind}, _block long, _at binary, _first double"), "candidates")

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks in order: the first of a group starts with _now, each other one where its predecessor ended."""
        group, last = None, 0.0
        for pdf in frames:
            enters, cuts, exits = [], [], []
            for row in pdf.itertuples(index=False):
                own = (row[0], row[2])
                start, group = (last if own == group else row[4]), own
                if row[6] is not None and row[5] == start:  # as before
                    found, last = row[6], row[7]
                else:
                    found, last = _folded(np.frombuffer(row[3], dtype="<f8"), start, longest, shortest)
                enters.append(start)
                cuts.append(found)
                exits.append(last)
            yield pd.DataFrame({key: pdf.iloc[:, 0], "_block": pdf["_block"], "_at": pdf["_at"], "_enters": enters, "_cuts": cuts, "_exit": exits})

    layout = f"`{key}` {kind}, _block long, _at binary, _enters double, _cuts array<double>, _exit double"
    before = Window.partitionBy(key).orderBy("_block")
    known = packed.select(key, "_block", "_at", F.when(F.col("_block") == 0, 0.0).otherwise(F.col("_first")).alias("_now"), F.lit(None).cast("double").alias("_enters"), F.lit(None).cast("array<double>").alias("_cuts"), F.lit(None).cast("double").alias("_exit"))
    span = 1
    while True:
        grouped = known.withColumn("_group", F.floor(F.col("_block") / span)).select(key, "_block", "_group", "_at", "_now", "_enters", "_cuts", "_exit")
        state = stored(grouped.repartition(key, "_group").sortWithinPartitions(key, "_block").mapInPandas(walk, layout), "cuts")
        known = state.withColumn("_now", F.coalesce(F.lag("_exit").over(before), F.lit(0.0)))
        if not known.where("_now <> _enters").limit(1).count():
            break
        span *= 4
    ended = state.groupBy(key).agg(F.max_by("_exit", "_block").alias("_last"), F.sum(F.size("_cuts")).alias("_n"))
    inner = state.withColumn("_before", F.coalesce(F.sum(F.size("_cuts")).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = inner.select(key, "_before", F.posexplode("_cuts").alias("_i", "cut")).select(key, (F.col("_before") + F.col("_i")).alias("i"), "cut")
    # after the last candidate, cuts are forced to the end
    tail = durations.select(key, "duration").join(ended, key, "left").withColumns({"_last": F.coalesce("_last", F.lit(0.0)), "_n": F.coalesce("_n", F.lit(0).cast("long"))})
    more = F.ceil((F.col("duration") - F.col("_last")) / longest) - 1
    forced = tail.where(more > 0).select(key, "_last", "_n", F.explode(F.sequence(F.lit(1).cast("long"), more)).alias("_k"))
    return inner.union(forced.select(key, (F.col("_n") + F.col("_k") - 1).alias("i"), (F.col("_last") + F.col("_k") * longest).alias("cut")))


def cuts_of(words: DataFrame, durations: DataFrame, key: str) -> DataFrame:
    """(key, cuts, duration) of every recording."""
    by = gap_candidates(words, key).groupBy(key).agg(F.sort_array(F.collect_list("at")).alias("at"))
    return durations.join(by, key, "left").select(key, greedy_cuts(F.coalesce("at", F.array().cast("array<double>")), F.col("duration")).alias("cuts"), "duration")


def assign_segments(words: DataFrame, cuts: DataFrame, key: str) -> DataFrame:
    """words with seg_no, seg_start and seg_end. Numbers count empty segments. Words are taken in order: one that
    starts before its predecessor stays in the predecessor's segment, and from the first that starts at or after the
    duration on all drop out."""
    reach = F.max("start").over(Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    joined = words.withColumn("reach", reach).join(cuts, key).where("reach < duration")
    number = F.size(F.filter("cuts", lambda c: c <= F.col("reach")))
    out = joined.withColumn("seg_no", number)
    edge = lambda i, other: F.coalesce(F.get("cuts", i), other)
    return out.withColumns({"seg_start": F.when(F.col("seg_no") == 0, 0.0).otherwise(edge(F.col("seg_no") - 1, F.lit(0.0))), "seg_end": edge(F.col("seg_no"), F.col("duration"))}).drop("cuts", "reach")


def segments(assigned: DataFrame, key: str) -> DataFrame:
    """(key, segment_id, start, end, text) of the segments that hold words."""
    by = assigned.groupBy(key, "seg_no", "seg_start", "seg_end").agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("words"))
    return by.select(key, F.format_string("seg_%04d", F.col("seg_no")).alias("segment_id"), F.col("seg_start").alias("start"), F.col("seg_end").alias("end"), F.array_join(F.transform("words", lambda w: w["text"]), " ").alias("text"))


def middle_window(words: DataFrame, durations: DataFrame, key: str, seconds: float = MIDDLE_SECONDS) -> DataFrame:
    """The words that start in the middle `seconds` of their recording, their times counted from its start."""
    low = F.greatest(F.lit(0.0), (F.col("duration") - seconds) / 2)
    joined = words.join(durations, key).withColumn("low", low)
    inside = joined.where((F.col("start") >= F.col("low")) & (F.col("start") < F.col("low") + F.least(F.col("duration"), F.lit(seconds))))
    return inside.withColumns({"start": F.col("start") - F.col("low"), "end": F.col("end") - F.col("low")}).drop("low", "duration")


def wpm_buckets(words: DataFrame, durations: DataFrame, key: str, bucket: float = BUCKET_SECONDS, least: float = MIN_BUCKET_SECONDS) -> DataFrame:
    """(key, i, span, words, wpm): every bucket, empty ones too, but for a last one shorter than `least`."""
    counts = words.groupBy(key, F.floor(F.col("start") / bucket).alias("i")).agg(F.sum(F.size(tx.tokens(F.col("text")))).alias("words"))
    all_of = durations.where("duration > 0").select(key, "duration", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("duration") / bucket))).alias("i"))
    span = F.least(F.lit(bucket), F.col("duration") - F.col("i") * bucket)
    out = all_of.withColumn("span", span).where(F.col("span") >= least).join(counts, [key, "i"], "left")
    total = F.coalesce("words", F.lit(0))
    return out.select(key, "i", "span", total.alias("words"), (total / (F.col("span") / 60)).alias("wpm"))


def pace(buckets: DataFrame, key: str, share: float = COLLAPSE) -> DataFrame:
    """(key, first_wpm, last_wpm, collapsed): the first bucket that has any words, the last one, and whether the last is
    another one and thinner than `share` of the first."""
    ends = buckets.groupBy(key).agg(F.min(F.when(F.col("wpm") > 0, F.struct("i", "wpm"))).alias("first"), F.max(F.struct("i", "wpm")).alias("last"))
    thin = (F.col("first.i") < F.col("last.i")) & (F.col("last.wpm") < F.col("first.wpm") * share)
    return ends.select(key, F.col("first.wpm").alias("first_wpm"), F.col("last.wpm").alias("last_wpm"), F.coalesce(thin, F.lit(False)).alias("collapsed"))


def wpm_collapse(buckets: DataFrame, key: str, share: float = COLLAPSE) -> DataFrame:
    """(key, collapsed): the last bucket is thinner than `share` of the first that has any words, and another one."""
    return pace(buckets, key, share).select(key, "collapsed")


def islands(frame: DataFrame, key: str, order: str, flag: Column) -> DataFrame:
    """(key, first, last, n): maximal runs of rows with the flag, by place."""
    rows = frame.select(key, order, flag.alias("flag"), F.row_number().over(Window.partitionBy(key).orderBy(order)).alias("rn")).where("flag")
    rows = rows.withColumn("island", F.col("rn") - F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return rows.groupBy(key, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("island")


def rms(samples: Column, frame: int, hop: int) -> Column:
    """Root mean squares of the sliding frames of one sample array: the whole ones, or all samples where they are too
    few for one; 0 without samples."""
    n = F.greatest(F.lit(0), F.floor((F.size(samples) - frame) / hop).cast("int"))
    root = lambda part: F.when(F.size(part) > 0, F.sqrt(F.aggregate(part, F.lit(0.0), lambda a, x: a + x * x) / F.size(part))).otherwise(0.0)
    return F.transform(F.sequence(F.lit(0), n), lambda i: root(F.slice(samples, i * hop + 1, frame)))


SILENCE_SHARE, SILENCE_SECONDS = 0.15, 0.3


def silence_midpoints(frames: DataFrame, key: str, order: str, value: str, hop_seconds: float, share: float = SILENCE_SHARE, seconds: float = SILENCE_SECONDS) -> DataFrame:
    """(key, at): midpoints in seconds of the quiet runs of each recording that last long enough. order: the frame's
    number from 0; quiet frames lie at or below the recording's own percentile, which is interpolated and exact at any length."""
    levels = percentiles(frames, [key], value, share, "_level")
    runs = islands(frames.join(levels, key), key, order, F.col(value) <= F.col("_level"))
    return runs.where(F.col("n") >= seconds / hop_seconds).select(key, ((F.col("first") + F.col("last")) / 2 * hop_seconds).alias("at"))


def proportional_split(text: Column, durations: Column) -> Column:
    """The text's words in as many pieces as there are durations, cut at the rounded (half to even) share
    of the words that each end time has; the last piece takes the rest."""
    bound = F.transform(F.array(F.struct(tx.tokens(text).alias("w"), durations.alias("d"))), lambda p: p)

    def pieces(p: Column) -> Column:
        total = F.aggregate(p["d"], F.lit(0.0), lambda a, x: a + x)
        n = F.size(p["w"])
        until = lambda k: F.aggregate(F.slice(p["d"], F.lit(1), k), F.lit(0.0), lambda a, x: a + x)
        end = lambda k: F.when(k == F.size(p["d"]), n).when(k == 0, 0).otherwise(F.greatest(F.lit(0), F.least(n, F.bround(n * until(k) / total).cast("int"))))
        cut = lambda k: F.array_join(F.slice(p["w"], end(k - 1) + 1, F.greatest(F.lit(0), end(k) - end(k - 1))), " ")
        return F.when(F.size(p["d"]) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(p["d"]))), cut)).otherwise(F.array().cast("array<string>"))

    return F.get(F.transform(bound, pieces), F.lit(0))
