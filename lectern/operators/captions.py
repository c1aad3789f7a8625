"""Screening of caption tracks before a recording is taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators import corpus, timeline

# Fixed value: the suffix that marks a track as the recognised original.
ORIGINAL = " (Original)"


def track_names(tracks: Column) -> Column:
    """language -> name of its first entry."""
    return F.transform_values(tracks, lambda _, entries: F.get(entries, F.lit(0))["name"])


def vietnamese_keys(tracks: Column) -> Column:
    return F.array_sort(F.filter(F.map_keys(tracks), lambda k: (k == "vi") | k.startswith("vi-")))


def original_keys(tracks: Column) -> Column:
    marked = F.map_filter(tracks, lambda _, entries: F.exists(entries, lambda e: F.coalesce(F.endswith(e["name"], F.lit(ORIGINAL)), F.lit(False))))
    return F.array_sort(F.map_keys(marked))


def screen(frame: DataFrame, tracks: str = "automatic_captions") -> DataFrame:
    """frame with ok, rule (1 or 2 if rejected), reason and track: a Vietnamese track must exist and be the recognised original."""
    have = F.coalesce(F.col(tracks), F.create_map().cast(frame.schema[tracks].dataType))
    vi, original = vietnamese_keys(have), original_keys(have)
    both = F.filter(original, lambda k: F.array_contains(vi, k))
    rule = F.when(F.size(vi) == 0, 1).when(F.size(both) == 0, 2)
    reason = F.when(rule.isNull(), "accepted").when(rule == 1, "no Vietnamese track").when(F.size(original) == 0, "no track is marked as the original")
    reason = reason.otherwise(F.concat(F.lit("the original is "), F.array_join(original, ", ")))
    return frame.withColumns({"rule": rule, "reason": reason, "ok": rule.isNull(), "track": F.when(rule.isNull(), F.get(both, F.lit(0)))})


def owner_keys(tracks: Column) -> Column:
    """Languages of the owner's subtitles in the order to try them: the Vietnamese ones, or all if there is none."""
    own = vietnamese_keys(tracks)
    return F.when(F.size(own) > 0, own).otherwise(F.array_sort(F.map_keys(tracks)))


def screen_pace(screened: DataFrame, pace: DataFrame, key: str) -> DataFrame:
    """screened after rule 3, with first_wpm and last_wpm: an accepted recording whose draft thins out towards its end is
    rejected and keeps its track. pace: rows of `timeline.pace`; recordings without one stay as they are."""
    joined = screened.join(pace, key, "left")
    fails = F.col("ok") & F.coalesce("collapsed", F.lit(False))
    whole = lambda c: F.bround(F.col(c)).cast("long").cast("string")
    reason = F.concat(F.lit("words a minute fall from "), whole("first_wpm"), F.lit(" to "), whole("last_wpm"))
    found = {"rule": F.when(fails, 3).otherwise(F.col("rule")), "reason": F.when(fails, reason).otherwise(F.col("reason")), "ok": F.col("ok") & ~fails}
    return joined.withColumns(found).drop("collapsed")


def probe(recordings: DataFrame, drafts: DataFrame, key: str, bucket: float = timeline.BUCKET_SECONDS, least: float = timeline.MIN_BUCKET_SECONDS, share: float = timeline.COLLAPSE) -> DataFrame:
    """recordings (key, duration, automatic_captions) after the three rules, with the measures of their drafts.

    drafts (key, events) are read for recordings that rules 1 and 2 accept. Those without a draft keep the verdict of
    these two rules, and null measures.
    """
    screened = screen(recordings)
    wanted = screened.where("ok").select(key, "duration")
    docs = drafts.join(wanted, key, "left_semi")
    durations = wanted.join(docs.select(key), key, "left_semi")
    words = timeline.parse(docs, "json3", key)
    # a recording's seconds ride on its first word
    timed = words.join(durations, key).withColumn("seconds", F.when(F.col("ord") == 0, F.col("duration")).otherwise(0.0))
    measures = timeline.timing_counts(docs, key).join(corpus.text_stats(timed, "text", key, seconds="seconds"), key)
    buckets = timeline.wpm_buckets(words, durations, key, bucket, least)
    return screen_pace(screened, timeline.pace(buckets, key, share), key).join(measures, key, "left")


def richest_attempt(attempts: DataFrame, key: str) -> DataFrame:
    """Of several tries, the one with the most tracks, the earliest of equals."""
    return attempts.groupBy(key).agg(F.max_by("attempt", F.struct(F.col("n_tracks"), -F.col("attempt"))).alias("attempt"), F.max("n_tracks").alias("n_tracks"))
