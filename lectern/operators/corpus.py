"""Corpus building: splits, merges, corrections, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as tx

SPLITS = ("train", "val", "test")


def fail(*parts) -> Column:
    return F.raise_error(F.concat(*[F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(p) for p in parts]))


def resolved_split(split: Column, meeting: Column, val_meetings: list[str] | None = None, in_val: Column | None = None) -> Column:
    """test stays test; demo becomes val for validation meetings and train for others; anything else is an error."""
    val = in_val if in_val is not None else meeting.isin(*(val_meetings or [""]))
    return F.when(split == "test", "test").when(split == "demo", F.when(F.coalesce(val, F.lit(False)), "val").otherwise("train")).otherwise(fail("unknown split ", split).cast("string"))


def resolve_splits(records: DataFrame, val_meetings: list[str]) -> DataFrame:
    """records with split overwritten; every other field passes through."""
    return records.withColumn("split", resolved_split(F.col("split"), F.col("meeting_id"), val_meetings))


def only_split(records: DataFrame, split: str, limit: int | None = None) -> DataFrame:
    """Records of one split, the first `limit` in order if any is given."""
    return first_of(records.where(F.col("split") == split), limit)


def first_of(records: DataFrame, limit: int | None, order: str = "ord") -> DataFrame:
    """The first rows in order; all without a limit, or with 0."""
    return records.orderBy(order).limit(limit) if limit else records


def split_of_source(records: DataFrame, split: str, source: str) -> DataFrame:
    """Records of one split and source; none at all is an error."""
    found = records.where((F.col("split") == split) & (F.col("source") == source))
    if not found.head(1):
        raise ValueError(f"no {split} records of {source}")
    return found


def split_counts(records: DataFrame, *keys: str) -> DataFrame:
    """train, val and test counts, zero where there are none."""
    return records.groupBy(*keys).agg(*[F.count_if(F.col("split") == s).alias(s) for s in SPLITS])


def remap_new_batch(split: Column) -> Column:
    """Splits of a later delivery: train and demo are demo, test is test, others are errors."""
    return F.when(split.isin("train", "demo"), "demo").when(split == "test", "test").otherwise(fail("unknown split ", split).cast("string"))


def renamed_meeting(meeting: Column, pattern: str, template: str) -> Column:
    """template % the pattern's first group, over the whole id; an id that doesn't match is an error."""
    found = F.regexp_extract(meeting, f"^(?:{pattern})$", 1)
    return F.when(found != "", F.format_string(template, found)).otherwise(fail("unexpected meeting ", meeting).cast("string"))


def replace_first(text: Column, old: Column, new: Column) -> Column:
    at = F.position(old, text)
    return F.when(at > 0, F.overlay(text, new, at, F.length(old))).otherwise(text)


def ingest_delivery(delivery: DataFrame, legacy: DataFrame, pattern: str, template: str) -> DataFrame:
    """One corpus from a new delivery and an older one's test meetings.

    Splits of the delivery are remapped; legacy records have to be test ones, become demo, and their meeting gets a
    new name, in the path of their audio too (its first place). An id that both have is an error.
    """
    new = delivery.withColumn("split", remap_new_batch(F.col("split")))
    name = renamed_meeting(F.col("meeting_id"), pattern, template)
    split = F.when(F.col("split") == "test", "demo").otherwise(fail("legacy split of ", F.col("meeting_id"), " is ", F.col("split")).cast("string"))
    old = legacy.withColumns({"split": split, "audio_filepath": replace_first(F.col("audio_filepath"), F.col("meeting_id"), name), "meeting_id": name})
    clash = new.select("meeting_id").distinct().join(old.select("meeting_id").distinct(), "meeting_id")
    checked = F.when(F.col("_clash"), fail("meeting in both deliveries: ", F.col("meeting_id")).cast("string")).otherwise(F.col("meeting_id"))
    both = merge_sources(new, old)
    return both.join(clash.withColumn("_clash", F.lit(True)), "meeting_id", "left").withColumn("meeting_id", checked).drop("_clash").select(*both.columns)


def ingest_summary(records: DataFrame, test_prefix: str, legacy_prefix: str) -> DataFrame:
    """One row: meetings and segments of the delivery's train and test parts and of the legacy part, told by id."""
    kind = F.when(F.col("meeting_id").startswith(legacy_prefix), "legacy").when(F.col("meeting_id").startswith(test_prefix), "test").otherwise("train")
    rows = records.groupBy("meeting_id").agg(F.count("*").alias("n")).withColumn("kind", kind)
    parts = {k: F.col("kind") == k for k in ("train", "test", "legacy")}
    meetings = [F.count_if(c).alias(f"{k}_meetings") for k, c in parts.items()]
    segments = [F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(f"{k}_segments") for k, c in parts.items()]
    return rows.agg(*meetings, *segments)


def merge_sources(*sources: DataFrame) -> DataFrame:
    """Bag union by name; fields that a source lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def apply_corrections(records: DataFrame, corrections: DataFrame, reviewer: str | None = None, date: str | None = None, blank: bool = False) -> DataFrame:
    """records with corrected text and verified set. A record without a correction is an error, and so is one with a blank
    one, unless `blank` says that texts may be empty; corrections of no record are passed over."""
    joined = records.join(corrections.select("segment_id", F.col("text").alias("_new"), F.lit(True).alias("_found")), "segment_id", "left")
    given = F.col("_found") if blank else F.length(tx.squeeze(F.coalesce("_new", F.lit("")))) > 0
    text = F.when(given, F.col("_new")).otherwise(fail("no correction for ", F.col("segment_id")).cast("string"))
    out = joined.withColumn("text", text).withColumn("verified", F.lit(True))
    if reviewer is not None:
        out = out.withColumns({"reviewed_by": F.lit(reviewer), "review_date": F.lit(date)})
    return out.drop("_new", "_found")


def corrected_subset(records: DataFrame, corrections: DataFrame, skip: list[str], upto: int, open_mark: str = "<??>") -> DataFrame:
    """Records that have a usable correction, with its text: numbers up to `upto`, none of `skip`; an open mark is an error."""
    number = F.coalesce(F.nullif(F.regexp_extract("segment_id", r"(\d+)$", 1), F.lit("")).cast("int"), F.lit(0))
    wanted = corrections.withColumn("_n", number).where((F.col("_n") <= upto) & ~F.col("segment_id").isin(*(skip or [""])))
    checked = F.when(F.contains("text", F.lit(open_mark)), fail("open mark in ", F.col("segment_id")).cast("string")).otherwise(F.col("text"))
    joined = wanted.select("segment_id", checked.alias("_new")).join(records, "segment_id", "left")
    return joined.withColumn("text", F.when(F.col("text").isNull() & F.col("meeting_id").isNull(), fail("no record ", F.col("segment_id")).cast("string")).otherwise(F.col("_new"))).drop("_new")


def split_source_report(records: DataFrame, split: str = "split", source: str = "source", duration: str = "duration") -> DataFrame:
    """(split, source, segments, minutes, percent): each source's share of its split's duration."""
    by = records.groupBy(F.col(split).alias("split"), F.coalesce(F.col(source), F.lit("unknown")).alias("source")).agg(F.count("*").alias("segments"), F.sum(duration).alias("total"))
    whole = F.sum("total").over(Window.partitionBy("split"))
    return by.select("split", "source", "segments", (F.col("total") / 60).alias("minutes"), F.when(whole > 0, 100 * F.col("total") / whole).alias("percent"))


def label_summary(records: DataFrame, column: str, default: str = "n/a") -> DataFrame:
    """One row: the column's distinct values, sorted, joined by commas."""
    return records.agg(F.array_join(F.array_sort(F.collect_set(column)), ", ").alias("labels")).select(F.when(F.col("labels") == "", default).otherwise(F.col("labels")).alias("labels"))


def source_totals(records: DataFrame, source: str, duration: str, label: str | None = None) -> DataFrame:
    """(source, segments, minutes) and, with a label column, its distinct values of each source."""
    more = [] if label is None else [F.array_join(F.array_sort(F.collect_set(label)), ", ").alias("labels")]
    out = records.groupBy(source).agg(F.count("*").alias("segments"), (F.sum(duration) / 60).alias("minutes"), *more)
    return out if label is None else out.withColumn("labels", F.coalesce(F.nullif("labels", F.lit("")), F.lit("n/a")))


def provenance_markdown(totals: DataFrame) -> DataFrame:
    """(line): a Markdown table row for each source of `source_totals`."""
    cells = [F.col(totals.columns[0]).cast("string"), F.col("segments").cast("string"), F.format_string("%.1f", F.col("minutes")), *[F.col(c) for c in totals.columns[3:]]]
    return totals.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def expect_counts(records: DataFrame, key: str, **expected: int) -> DataFrame:
    """One row (keys, rows); counts other than the expected ones are errors."""
    out = records.agg(F.count_distinct(key).alias("keys"), F.count("*").alias("rows"))
    for name, n in expected.items():
        out = out.withColumn(name, F.when(F.col(name) == n, F.col(name)).otherwise(fail(f"{n} {name} expected, found ", F.col(name)).cast("long")))
    return out


def code_switch(records: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, segments, switching, share): segments with a loanword at least."""
    found = records.select(*keys, F.exists(tx.tokens(F.col(text)), tx.is_loanword).alias("_s"))
    return found.groupBy(*keys).agg(F.count("*").alias("segments"), F.count_if("_s").alias("switching")).withColumn("share", F.col("switching") / F.col("segments"))


def longest_texts(records: DataFrame, text: str, top: int, *keys: str, order: str = "ord") -> DataFrame:
    """(keys, order, n_tokens, rank) of the texts with the most tokens under each key, ties in order."""
    rows = records.select(*keys, order, F.size(tx.tokens(F.col(text))).alias("n_tokens"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n_tokens"), order))).where(F.col("rank") <= top)


def token_vocabulary(frame: DataFrame, text: str, meeting: str, least: int = 3, keep=tx.is_loanword) -> DataFrame:
    """(token, n, meetings) of tokens that occur in at least `least` meetings. Each distinct token is judged once."""
    words = frame.select(F.col(meeting).alias("m"), F.explode(tx.tokens(F.col(text))).alias("token"))
    per = words.groupBy("token", "m").agg(F.count("*").alias("n"))
    return per.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("meetings")).where(tx.once(F.col("n"), (F.col("meetings") >= least) & keep(F.col("token"))))


def top_vocabulary(frame: DataFrame, text: str, meeting: str, top: int = 25, least: int = 3, order: str = "ord", keep=tx.is_loanword) -> DataFrame:
    """(token, n, meetings, rank): the most frequent of the tokens that occur in at least `least` meetings, of equals the
    one met first. Each distinct token is judged once; the top is taken in every task before it is taken of all."""
    words = frame.select(F.col(meeting).alias("m"), F.col(order).alias("_o"), F.posexplode(tx.tokens(F.col(text))).alias("_p", "token"))
    per = words.groupBy("token", "m").agg(F.count("*").alias("n"), F.min(F.struct("_o", "_p")).alias("_first"))
    found = per.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("meetings"), F.min("_first").alias("_first")).where(tx.once(F.col("n"), (F.col("meetings") >= least) & keep(F.col("token"))))
    first = found.orderBy(F.desc("n"), "_first").limit(top)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "_first"))).drop("_first")  # `top` rows


def top_tokens(frame: DataFrame, text: str, top: int, *keys: str, order: str = "ord", form=lambda t: t, keep=tx.is_loanword) -> DataFrame:
    """(keys, token, n, rank): under each key the most frequent tokens, of equals the one met first."""
    words = frame.select(*keys, F.col(order).alias("_o"), F.posexplode(tx.tokens(F.col(text))).alias("_p", "token")).withColumn("token", form(F.col("token")))
    counts = words.groupBy(*keys, "token").agg(F.count("*").alias("n"), F.min(F.struct("_o", "_p")).alias("_first")).where(tx.once(F.col("n"), keep(F.col("token"))))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "_first"))).where(F.col("rank") <= top).drop("_first")


def label_counts(frame: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, label, n): how often each bracketed label stands in whole texts."""
    return frame.select(*keys, F.explode(tx.labels(F.col(text))).alias("label")).groupBy(*keys, "label").agg(F.count("*").alias("n"))


def transcripts(words: DataFrame, key: str) -> DataFrame:
    """(key, text): the words of each recording in order, joined by spaces, so that labels over several words are whole."""
    by = words.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("w"))
    return by.select(key, F.array_join(F.transform("w", lambda w: w["text"]), " ").alias("text"))


def histogram(frame: DataFrame, value: Column, low: int, high: int) -> DataFrame:
    """(bin, n): unit bins from low up to high, where `high` itself falls into the last; values outside drop out."""
    rows = frame.select(value.alias("v")).where((F.col("v") >= low) & (F.col("v") <= high))
    return rows.groupBy(F.least(F.floor("v"), F.lit(high - 1)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def text_stats(words: DataFrame, text: str, *keys: str, seconds: str | None = None) -> DataFrame:
    """Per key: word entries and those of several tokens, words, marks in 100 words, rates of digits, particles and
    loanwords, labels, and with a column of seconds loanwords a minute.

    One pass counts tokens under their key, and each distinct token is judged once. `label_counts` and `top_tokens`
    give the labels and the most frequent loanwords themselves.
    """
    found = tx.tokens(F.col(text))
    base = words.select(*keys, found.alias("tokens"), tx.mark_count(F.col(text)).alias("marks"), F.size(tx.labels(F.col(text))).alias("labels"), (F.col(seconds) if seconds else F.lit(0.0)).cast("double").alias("seconds"))
    # what belongs to a row rides on its first token, or on a null one where it has none
    rows = base.select(*keys, "marks", "labels", "seconds", (F.size("tokens") > 1).cast("int").alias("several"), F.posexplode_outer("tokens").alias("place", "token"))
    of_row = lambda c: F.sum(F.when(F.coalesce(F.col("place"), F.lit(0)) == 0, F.col(c))).alias(c)
    counts = rows.withColumn("entries", F.lit(1)).groupBy(*keys, "token").agg(F.count("token").alias("n"), *[of_row(c) for c in ("marks", "labels", "seconds", "several", "entries")])
    bare = tx.bare(F.col("token"))
    kinds = {"digits": tx.has_digit(F.col("token")), "particles": bare.isin(*tx.LEXICAL_PARTICLES), "loans": tx.is_loanword(bare)}
    out = counts.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "marks", "labels", "seconds", "several", "entries")], *[F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).alias(c) for c, test in kinds.items()])
    over = lambda c, by=1: F.when(F.col("n") > 0, by * F.col(c) / F.col("n")).otherwise(0.0)
    rates = [F.col("n").alias("n_words"), over("marks", 100).alias("punctuation_per_100_words"), over("digits").alias("digit_word_rate"), over("particles").alias("lexical_particle_rate"), over("loans").alias("nonvietnamese_word_rate"), F.col("labels").alias("n_labels")]
    minute = [] if seconds is None else [F.when(F.col("seconds") > 0, F.col("loans") / (F.col("seconds") / 60)).otherwise(0.0).alias("nonvietnamese_words_per_min")]
    return out.select(*keys, F.col("entries").alias("n_word_entries"), F.col("several").alias("multi_token_entries"), *rates, *minute)
