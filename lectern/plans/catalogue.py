"""Queries that apply each operator to whole tables, and DuckDB SQL for the same rows.

Segments are the lines and sentences of `documents`, their language stands for the meeting
and `source` for the slice. The two hypotheses of a segment are fixed corruptions of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import checks, corpus, gate, scoring, stats, timeline
from lectern.plans import oracle_text as ot
from lectern.sources.layout import spread, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(build):
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ord, ref, hyp, base: every line and sentence of every document."""
    docs = table(spark, sf_dir, "documents")
    parts = docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", r"\n|\. ")).alias("pos", "part"))
    rows = parts.select("doc_id", "lang", "source", (F.col("doc_id") * 1000000 + F.col("pos")).alias("ord"), F.trim(F.lower("part")).alias("ref")).where("ref <> ''")
    hyp = F.replace("ref", F.lit("of the "), F.lit("of te "))
    return rows.withColumns({"hyp": hyp, "base": F.replace(hyp, F.lit("in the "), F.lit("in e "))})


SEGMENTS = r"""
segments as (
  select *, replace(hyp, 'in the ', 'in e ') as base from (
    select doc_id, lang, source, doc_id * 1000000 + pos as ord, ref, replace(ref, 'of the ', 'of te ') as hyp from (
      select doc_id, lang, source, pos, trim(lower(parts[pos + 1]), ' ') as ref from (
        select doc_id, lang, source, parts, unnest(range(len(parts))) as pos from (
          select doc_id, lang, source, string_split_regex(text, '\n|\. ') as parts from documents))) where ref <> ''))"""


def edit_ctes(name: str, hyp: str = "hyp", unit: str = "''", source: str = "segments") -> str:
    """CTE `name` (ref, hyp, edits) of pairs that differ, by a plain distance table over what is left
    between their common beginning and end."""
    return f"""
{name}_a as (select ref, hyp, string_split(ref, {unit}) as r, string_split(hyp, {unit}) as h from (select distinct ref, {hyp} as hyp from {source} where ref <> {hyp})),
{name}_b as (select ref, hyp, list_reverse(r[p + 1:]) as r, list_reverse(h[p + 1:]) as h from (
  select *, coalesce(list_position([r[i] = h[i] for i in range(1, least(len(r), len(h)) + 1)], false) - 1, least(len(r), len(h))) as p from {name}_a)),
{name}_c as (select ref, hyp, r[p + 1:] as r, h[p + 1:] as h from (
  select *, coalesce(list_position([r[i] = h[i] for i in range(1, least(len(r), len(h)) + 1)], false) - 1, least(len(r), len(h))) as p from {name}_b)),
{name} as (select ref, hyp, case when len(r) = 0 then len(h) when len(h) = 0 then len(r) else
  list_reduce(list_concat([list_transform(range(len(h)::bigint + 1), lambda j: j::bigint)], list_transform(range(len(r)::bigint), lambda i: [i::bigint])),
    lambda prev, row: list_reduce(list_concat([[prev[1] + 1]], list_transform(range(1, len(h)::bigint + 1), lambda j: [j::bigint])),
      lambda cur, jj: list_append(cur, least(prev[jj[1] + 1] + 1, cur[-1] + 1, prev[jj[1]] + (case when r[row[1] + 1] = h[jj[1]] then 0 else 1 end)))))[-1] end::bigint as edits
  from {name}_c)"""


SCORED = f"with {SEGMENTS}, {edit_ctes('d')}, scored as (select s.*, coalesce(d.edits, 0) as char_edits, length(s.ref)::bigint as char_ref_len from segments s left join d on s.ref = d.ref and s.hyp = d.hyp)"


def scored(spark: SparkSession, sf_dir: str, hyp: str = "hyp", words: bool = False) -> DataFrame:
    rows = segments(spark, sf_dir)
    return scoring.counted(rows.withColumn("hyp", F.col(hyp)).drop("base"), words=words)


_SCORE_SQL = SCORED + """
select {key}, count(*) as n_segments, sum(char_edits)::bigint as char_edits, sum(char_ref_len)::bigint as char_ref_len, round(sum(char_edits) / sum(char_ref_len), 6) as cer
from scored group by {key}"""


@query(_SCORE_SQL.format(key="source"))
def score_by_source(spark, sf_dir):
    return scoring.score_by(scored(spark, sf_dir), "source", words=False).withColumn("cer", r6("cer"))


@query(_SCORE_SQL.format(key="lang"))
def score_by_meeting(spark, sf_dir):
    return scoring.score_by(scored(spark, sf_dir), "lang", words=False).withColumn("cer", r6("cer"))


_TOKENS = "list_filter(string_split_regex({0}, '\\s+'), lambda t: t <> '')"


@query(f"""with {SEGMENTS}, toks as (select source, array_to_string({_TOKENS.format('ref')}, ' ') as ref, array_to_string({_TOKENS.format('base')}, ' ') as hyp from segments where true), {edit_ctes('d', unit="' '", source='toks')}
select source, sum(coalesce(d.edits, 0))::bigint as word_edits, sum(len({_TOKENS.format('t.ref')}))::bigint as word_ref_len, round(sum(coalesce(d.edits, 0)) / sum(len({_TOKENS.format('t.ref')})), 6) as wer
from toks t left join d on t.ref = d.ref and t.hyp = d.hyp group by source""")
def wer_by_source(spark, sf_dir):
    rows = segments(spark, sf_dir).select("source", "ref", F.col("base").alias("hyp"))
    counts = rows.select("source", tx.word_edits(F.col("ref"), F.col("hyp")).alias("e"), F.size(tx.tokens(F.col("ref"))).alias("n"))
    return counts.groupBy("source").agg(F.sum("e").alias("word_edits"), F.sum("n").alias("word_ref_len"), r6(scoring.rate("e", "n")).alias("wer"))


@query(f"""with {SEGMENTS}, {edit_ctes('d')}, {edit_ctes('e', hyp='base')},
t as (select coalesce(d.edits, 0) as c, coalesce(e.edits, 0) as b, length(s.ref) as n from segments s left join d on s.ref = d.ref and s.hyp = d.hyp left join e on s.ref = e.ref and s.base = e.hyp)
select count(*) as n_shared, round(sum(c) / sum(n), 6) as candidate_cer, round(sum(b) / sum(n), 6) as production_cer, sum(c) <= sum(b) as no_regression from t""")
def production_check(spark, sf_dir):
    keyed = segments(spark, sf_dir).select(F.col("lang").alias("meeting_id"), F.col("ord").alias("segment_id"), "ord", "ref", "hyp", "base")
    candidate = scoring.counted(keyed, words=False)
    production = scoring.counted(keyed.withColumn("hyp", F.col("base")), words=False)
    out = scoring.regression_check(candidate, production)
    return out.withColumns({"candidate_cer": r6("candidate_cer"), "production_cer": r6("production_cer")})


@query(SCORED + " select ord, char_edits, char_ref_len from scored order by char_edits desc, ord limit 50")
def rank_by_edits(spark, sf_dir):
    return scoring.ranked_by_edits(scored(spark, sf_dir), top=50).select("ord", "char_edits", "char_ref_len")


@query(SCORED + " select arg_max(ord, (char_edits, -ord)) as ord, max(char_edits) as edits, round(max(char_edits) / sum(char_edits), 6) as share from scored")
def top_segment_share(spark, sf_dir):
    return scoring.top_segment_share(scored(spark, sf_dir)).withColumn("share", r6("share"))


@query("""select conv_id, count(*) as n_chunks, string_agg(coalesce(text, ''), ' ' order by turn) as ref from conversations group by conv_id""")
def rejoin_chunks(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    text = F.coalesce("text", F.lit(""))
    chunks = turns.select(F.col("conv_id").alias("meeting_id"), F.format_string("seg_%04d_%d", F.lit(0), F.col("turn")).alias("segment_id"), F.col("turn").alias("ord"), text.alias("ref"), text.alias("hyp"))
    counts = turns.groupBy(F.col("conv_id").alias("meeting_id")).agg(F.count("*").alias("n_chunks"))
    return scoring.rejoin_chunks(chunks).join(counts, "meeting_id").select(F.col("meeting_id").alias("conv_id"), "n_chunks", "ref")


_LOAN = f"(length(t) > 1 and regexp_matches(t, '^\\p{{L}}+$') and not {ot.shape('t')})"
_RETAINED = f"""with {SEGMENTS},
w as (select source, ord, t, count(*) as wanted from (select source, ord, unnest({_TOKENS.format('ref')}) as t from segments) where {_LOAN} group by all),
g as (select ord, t, count(*) as there from (select ord, unnest({_TOKENS.format("replace(ref, 'ing', 'in')")}) as t from segments) group by all),
k as (select source, w.t as token, wanted, least(wanted, coalesce(there, 0)) as retained from w left join g on w.ord = g.ord and w.t = g.t)"""


def _dropped_g(spark, sf_dir):
    return segments(spark, sf_dir).select("source", "ord", "ref", F.replace("ref", F.lit("ing"), F.lit("in")).alias("hyp"))


def _lost(spark, sf_dir):
    return scoring.retained_tokens(_dropped_g(spark, sf_dir), ["source", "ord"], lost=True)


@query(_RETAINED + " select source, sum(wanted)::bigint as n_candidates, sum(retained)::bigint as n_retained, round(sum(retained) / sum(wanted), 6) as retention from k group by source")
def retention_by_source(spark, sf_dir):
    return scoring.retention_by(scoring.retained_sums(_dropped_g(spark, sf_dir), ["source"]), "source").withColumn("retention", r6("retention"))


@query(_RETAINED + " select token, sum(wanted - retained)::bigint as missing from k group by token having sum(wanted - retained) > 0")
def missing_tokens(spark, sf_dir):
    return scoring.missing_tokens(_lost(spark, sf_dir))


_FOREIGN = f"(not regexp_matches(t, '^\\p{{Nd}}+$') and not {ot.shape('t')})"


@query(f"""with {SEGMENTS}, c as (select source, list_filter({_TOKENS.format('ref')}, lambda t: {_FOREIGN}) as c, {_TOKENS.format("replace(ref, 'ing', 'in')")} as h from segments)
select source, count(*) as n_candidates, sum(case when len(list_filter(c, lambda x: not list_contains(h, x))) > 0 then 1 else 0 end)::bigint as n_dropped from c where len(c) > 0 group by source""")
def loanword_dropped(spark, sf_dir):
    rows = segments(spark, sf_dir).select("source", "ord", "ref", F.replace("ref", F.lit("ing"), F.lit("in")).alias("hyp"))
    return scoring.loanword_dropped(rows).groupBy("source").agg(F.count("*").alias("n_candidates"), F.count_if("dropped").alias("n_dropped"))


@query(f"""with {SEGMENTS}, c as (select source, regexp_extract_all(ref, '\\d+') as a, regexp_extract_all(replace(ref, '7', '1'), '\\d+') as b from segments)
select source, count(*) as n_with_digits, sum((a <> b)::bigint)::bigint as n_mismatch from c where len(a) > 0 group by source""")
def digit_mismatch(spark, sf_dir):
    rows = segments(spark, sf_dir).select("source", "ref", F.replace("ref", F.lit("7"), F.lit("1")).alias("hyp"))
    return scoring.digit_mismatch(rows).groupBy("source").agg(F.count("*").alias("n_with_digits"), F.count_if("mismatch").alias("n_mismatch"))


@query(f"""with t as (select source, unnest({_TOKENS.format('lower(text)')}) as t from documents)
select t as token, count(*) as n, count(distinct source) as meetings from t where {_LOAN} group by t having count(distinct source) >= 3""")
def token_vocab_ge3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", F.lower("text").alias("text"))
    return corpus.token_vocabulary(docs, "text", "source")


_BARE = "lower(trim(x, '.,?!:;\"''()[]…-–—'))"
_PARTICLES = ot.PARTICLES


@query(f"""with b as (select lang, n_chars, length(text) - length(translate(text, '.,?!:;', '')) as marks, len(regexp_extract_all(text, '\\[[^\\]\\n]{{1,40}}\\]')) as labels, {_TOKENS.format('text')} as ts from documents),
c as (select lang, n_chars, marks, labels, len(ts) as n, len(list_filter(ts, lambda x: regexp_matches(x, '\\p{{Nd}}'))) as digits,
  len(list_filter(ts, lambda x: {_BARE} in ({_PARTICLES}))) as particles,
  len(list_filter(list_transform(ts, lambda x: {_BARE}), lambda t: {_LOAN})) as loans from b)
select lang, count(*) as n_word_entries, count(*) filter (n > 1) as multi_token_entries, sum(n)::bigint as n_words, round(100 * sum(marks) / sum(n), 6) as punctuation_per_100_words, round(sum(digits) / sum(n), 6) as digit_word_rate,
  round(sum(particles) / sum(n), 6) as lexical_particle_rate, round(sum(loans) / sum(n), 6) as nonvietnamese_word_rate, sum(labels)::bigint as n_labels,
  round(sum(loans) / (sum(n_chars) / 15.0 / 60), 6) as nonvietnamese_words_per_min from c group by lang""")
def text_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("seconds", F.col("n_chars") / 15.0)
    out = corpus.text_stats(docs, "text", "lang", seconds="seconds")
    rates = ("punctuation_per_100_words", "digit_word_rate", "lexical_particle_rate", "nonvietnamese_word_rate", "nonvietnamese_words_per_min")
    return out.withColumns({**{c: r6(c) for c in rates}, "n_labels": F.col("n_labels").cast("long"), "n_word_entries": F.col("n_word_entries").cast("long"), "multi_token_entries": F.col("multi_token_entries").cast("long")})


@query("""select least(floor(n_chars / 1000.0), 19)::bigint as bin, count(*) as n from documents where n_chars / 1000.0 between 0 and 20 group by 1""")
def duration_histogram(spark, sf_dir):
    return corpus.histogram(table(spark, sf_dir, "documents"), F.col("n_chars") / 1000.0, 0, 20)


@query("""select doc_id, trim(regexp_replace(regexp_replace(lower(nfc_normalize(text)), '[.,!?;:"''`()\\[\\]{}<>/\\\\|~^*_=+&%$#@…“”‘’–—]', ' ', 'g'), '\\s+', ' ', 'g'), ' ') as text from documents""")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.normalize(F.col("text")).alias("text"))  # it has no number words


@query(f"""with t as (select lang, unnest({_TOKENS.format('lower(text)')}) as t from documents)
select lang, count(*) as n, sum(({ot.shape('t')})::bigint)::bigint as shaped from t group by lang""")
def vn_shape(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", F.explode(tx.tokens(F.lower("text"))).alias("t"))
    counts = rows.groupBy("lang", "t").agg(F.count("*").alias("n"))  # each distinct token is judged once
    return counts.groupBy("lang").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(tx.is_vietnamese_shaped(F.col("t")), F.col("n"))), F.lit(0)).alias("shaped"))


_SPLIT = "case when o_orderstatus = 'F' then 'test' when o_custkey % 10 = 0 then 'val' else 'train' end"


def _orders_as_records(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    raw = F.when(F.col("o_orderstatus") == "F", "test").otherwise("demo")
    split = corpus.resolved_split(raw, F.col("o_custkey"), in_val=F.col("o_custkey") % 10 == 0)
    return orders.select("o_orderkey", "o_custkey", split.alias("split"))


@query(f"select o_orderkey, {_SPLIT} as split from orders")
def resolve_splits(spark, sf_dir):
    return _orders_as_records(spark, sf_dir).select("o_orderkey", "split")


@query(f"with r as (select {_SPLIT} as split from orders) select count(*) filter (split = 'train') as train, count(*) filter (split = 'val') as val, count(*) filter (split = 'test') as test from r")
def split_stats(spark, sf_dir):
    return corpus.split_counts(_orders_as_records(spark, sf_dir))


@query(f"with r as (select o_custkey, {_SPLIT} as split from orders) select o_custkey, count(distinct split) as n from r group by o_custkey having count(distinct split) > 1")
def split_conflicts(spark, sf_dir):
    return checks.in_several(_orders_as_records(spark, sf_dir), "o_custkey", "split")


@query("""with b as (select lang as split, source, count(*) as segments, sum(n_chars) as total from documents group by all)
select split, coalesce(source, 'unknown') as source, segments, round(total / 60, 6) as minutes, round(100 * total / sum(total) over (partition by split), 6) as percent from b""")
def split_source_report(spark, sf_dir):
    return corpus.split_source_report(table(spark, sf_dir, "documents"), "lang", "source", "n_chars").withColumns({"minutes": r6("minutes"), "percent": r6("percent")})


@query("select string_agg(lang, ', ' order by lang) as labels from (select distinct lang from documents where lang is not null)")
def label_summary(spark, sf_dir):
    return corpus.label_summary(table(spark, sf_dir, "documents"), "lang")


@query("""select doc_id as segment_id, case when quality is null then text else 'q' || quality || ' ' || text end as text, true as verified from documents left join labels using (doc_id)""")
def apply_corrections(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    records = docs.select(F.col("doc_id").alias("segment_id"), "text")
    fixed = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").select(F.col("doc_id").alias("segment_id"), F.when(F.col("quality").isNull(), F.col("text")).otherwise(F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit(" "), F.col("text"))).alias("text"))
    return corpus.apply_corrections(records, fixed, blank=True).select("segment_id", "text", "verified")  # documents may be empty


@query("""with r as (select doc_id, quality = 1 as verified from documents left join labels using (doc_id)), u as (select doc_id from r where not coalesce(verified, false))
select (select count(*) from u) as n, (select string_agg(doc_id, ', ' order by doc_id) from (select doc_id from u order by doc_id limit 10)) as examples""")
def unverified(spark, sf_dir):
    records = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", (F.col("quality") == 1).alias("verified"))
    return checks.unverified_summary(records, "doc_id").withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), ", "))


@query("""select 'customer' as src, c_custkey as key, c_name as name, c_nationkey as nation, c_mktsegment as segment from customer
union all select 'supplier', s_suppkey, s_name, s_nationkey, null from supplier""")
def merge_sources(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("src"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("src"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return corpus.merge_sources(c, s)


@query("""with n as (select c_nationkey as k, 'customer' as src from customer union all select s_nationkey, 'supplier' from supplier)
select k as nation, count(distinct src) as n from n group by k having count(distinct src) > 1""")
def source_collisions(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("src"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("src"))
    return checks.in_several(a.union(b), "nation", "src")


_SENTENCES = r"select {0}, trim(unnest(string_split_regex(text, '\n|\. ')), ' .') as sentence from {1}"


@query(f"""with l as ({_SENTENCES.format('doc_id', 'documents')}), b as ({_SENTENCES.format('item_id', 'benchmark')})
select doc_id, count(*) as n_sentences from l where sentence <> '' and sentence in (select sentence from b) group by doc_id""")
def benchmark_contamination(spark, sf_dir):
    return checks.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text")


def timeline_of_events(spark, sf_dir) -> DataFrame:
    """Each user's events as words: text, start in seconds from the user's first, ord."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value", F.col("event_type").alias("text"))
    first = F.min("us").over(Window.partitionBy("user_id"))
    return rows.select("user_id", F.col("event_id").alias("ord0"), ((F.col("us") - first) / 1e6).alias("start"), "value", "text").withColumn("ord", F.struct("start", "ord0"))


_EVENTS = "with e as (select user_id, event_id, event_type, value, (epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id)) / 1e6 as start from events)"
_HOUR = 3600.0


def _durations(words: DataFrame) -> DataFrame:
    return words.groupBy("user_id").agg((F.max("start") + 60.0).alias("duration"))


@query(_EVENTS + """, d as (select user_id, max(start) + 60 as duration from e group by user_id),
b as (select user_id, duration, unnest(range(0, floor(duration / 86400)::bigint + 1)) as i from d),
c as (select user_id, floor(start / 86400)::bigint as i, count(*) as words from e group by all)
select b.user_id, b.i, round(least(86400, duration - b.i * 86400), 6) as span, coalesce(words, 0) as words, round(coalesce(words, 0) / (least(86400, duration - b.i * 86400) / 60), 6) as wpm
from b left join c on b.user_id = c.user_id and b.i = c.i where least(86400, duration - b.i * 86400) >= 3600""")
def wpm_buckets(spark, sf_dir):
    words = timeline_of_events(spark, sf_dir)
    out = timeline.wpm_buckets(words, _durations(words), "user_id", bucket=86400.0, least=_HOUR)
    return out.withColumns({"span": r6("span"), "wpm": r6("wpm"), "words": F.col("words").cast("long")})


@query(_EVENTS + """, g as (select user_id, start, lag(start) over (partition by user_id order by start, event_id) as before from e)
select user_id, round((start + before) / 2 * 2e6)::bigint as at_half_us from g where start - before >= 3600""")
def gap_candidates(spark, sf_dir):
    return timeline.gap_candidates(timeline_of_events(spark, sf_dir), "user_id", _HOUR).select("user_id", F.round(F.col("at") * 2e6).cast("long").alias("at_half_us"))


@query(_EVENTS + """, n as (select *, lead(start) over (partition by user_id order by start, event_id) as following from e)
select event_id, round(greatest(start, least(coalesce(following, start + value), start + value)), 6) as "end" from n""")
def infer_end(spark, sf_dir):
    words = timeline_of_events(spark, sf_dir).withColumn("display_end", F.col("start") + F.col("value"))
    return timeline.infer_end(words, "user_id").select(F.col("ord0").alias("event_id"), r6("end").alias("end"))


@query(_EVENTS + """ select user_id, case when start >= 604800 then 2 when start >= 86400 then 1 else 0 end as seg_no, count(*) as n from e group by all""")
def interval_assign(spark, sf_dir):
    words = timeline_of_events(spark, sf_dir)
    cuts = _durations(words).withColumn("cuts", F.array(F.lit(86400.0), F.lit(604800.0)))
    return timeline.assign_segments(words, cuts, "user_id").groupBy("user_id", "seg_no").agg(F.count("*").alias("n"))


@query(_EVENTS + """, d as (select user_id, max(start) + 60 as duration from e group by user_id)
select e.event_id, round((start - greatest(0, (duration - 864000) / 2)) * 2e6)::bigint as start_half_us from e join d using (user_id)
where start >= greatest(0, (duration - 864000) / 2) and start < greatest(0, (duration - 864000) / 2) + least(duration, 864000)""")
def middle_window(spark, sf_dir):
    words = timeline_of_events(spark, sf_dir).withColumn("end", F.col("start"))
    out = timeline.middle_window(words, _durations(words), "user_id", 864000.0)
    return out.select(F.col("ord0").alias("event_id"), F.round(F.col("start") * 2e6).cast("long").alias("start_half_us"))


@query(_EVENTS + """, l as (select user_id, quantile_cont(value, 0.15) as level from e group by user_id),
r as (select e.*, value <= level as quiet, row_number() over (partition by user_id order by start, event_id) - 1 as i from e join l using (user_id)),
q as (select *, i - row_number() over (partition by user_id order by i) as island from r where quiet)
select user_id, (min(i) + max(i)) / 2.0 * 0.25 as at from q group by user_id, island having count(*) >= 0.5 / 0.25""")
def silence_islands(spark, sf_dir):
    frames = timeline_of_events(spark, sf_dir).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ord")) - 1)
    return timeline.silence_midpoints(frames, "user_id", "i", "value", 0.25, seconds=0.5)


@query("""with r as (select user_id, event_id, value, (row_number() over (partition by user_id order by event_id) - 1) // 10 as block from events)
select user_id, max(event_id) as last, round(avg(value), 6) as mean from r group by user_id, block""")
def block_means(spark, sf_dir):
    return stats.block_means(table(spark, sf_dir, "events"), "event_id", "value", 10, "user_id").withColumn("mean", r6("mean"))


@query("""with r as (select user_id, value as v, row_number() over w as rn, count(*) over (partition by user_id) as n from events window w as (partition by user_id order by event_id)),
b as (select *, (rn - 1) // greatest(1, n // 10) as block from r), m as (select user_id, block, avg(v) as m from b group by all),
u as (select user_id, (m > lag(m) over (partition by user_id order by block))::int as up from m),
s as (select user_id, coalesce(sum(up), 0) / greatest(1, count(*) - 1) as rise_frac from u group by user_id)
select b.user_id, count(*) as steps, round(arg_min(v, rn), 6) as first, round(min(v), 6) as least, round(avg(v) filter (rn > n - 10), 6) as final, round(any_value(s.rise_frac), 6) as rise_frac, avg(v) filter (rn > n - 10) > arg_min(v, rn) as diverged
from b join s using (user_id) group by b.user_id""")
def lr_summary(spark, sf_dir):
    out = stats.curve_summary(table(spark, sf_dir, "events"), "event_id", "value", "user_id")
    return out.withColumns({c: r6(c) for c in ("first", "least", "final", "rise_frac")})


@query("""select user_id, arg_min(event_id, (value, event_id)) as at_least, arg_max(event_id, (value, -event_id)) as at_most from events group by user_id""")
def argmin_argmax(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.min_by("event_id", F.struct("value", "event_id")).alias("at_least"), F.max_by("event_id", F.struct(F.col("value"), -F.col("event_id"))).alias("at_most"))


@query("""with r as (select user_id, event_id, value, min(value) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as best from events),
g as (select *, sum((best is null or value < best)::int) over (partition by user_id order by event_id) as run from r),
s as (select *, row_number() over (partition by user_id, run order by event_id) - 1 as since from g)
select user_id, min(event_id) filter (since >= 5) as stopped_at from s group by user_id""")
def early_stopping(spark, sf_dir):
    return stats.early_stop(table(spark, sf_dir, "events"), "event_id", "value", 5, "user_id")


_WEIGHTED = SCORED.replace("select s.*,", "select s.*, coalesce(b.edits, 0) as base_edits,").replace("on s.ref = d.ref and s.hyp = d.hyp", "on s.ref = d.ref and s.hyp = d.hyp left join b on s.ref = b.ref and s.base = b.hyp").replace(", scored as", f", {edit_ctes('b', hyp='base')}, scored as") + ", narrow as (select source, ord, char_edits, base_edits, char_ref_len from scored)" + ot.poisson("narrow", "ord", 1000, 42)


@query(_WEIGHTED + """, s as (select source, b, sum(w * char_edits) as e, sum(w * char_ref_len) as n from weighted group by all),
v as (select source, list(e / n order by e / n) as v from s where n > 0 group by source)
select source, round(v[floor(len(v) * 0.025)::int + 1], 6) as lo, round(v[least(len(v) - 1, floor(len(v) * 0.975)::int) + 1], 6) as hi from v""")
def bootstrap_ci(spark, sf_dir):
    out = stats.bootstrap_ci(scored(spark, sf_dir), "source", method="poisson")
    return out.select("source", r6("lo").alias("lo"), r6("hi").alias("hi"))


@query(_WEIGHTED + """, s as (select source, b, sum(w * base_edits) as e, sum(w * char_edits) as c, sum(w * char_ref_len) as n from weighted group by all),
v as (select source, list(e / n - c / n order by e / n - c / n) as v from s where n > 0 group by source),
i as (select source, v[floor(len(v) * 0.025)::int + 1] as lo, v[least(len(v) - 1, floor(len(v) * 0.975)::int) + 1] as hi from v)
select source, round(lo, 6) as lo, round(hi, 6) as hi, case when lo > 0 then 'IMPROVED' when hi < 0 then 'REGRESSED' else 'INCONCLUSIVE' end as verdict from i""")
def bootstrap_delta(spark, sf_dir):
    rows = segments(spark, sf_dir)
    edits = lambda hyp: F.struct(tx.char_edits(F.col("ref"), F.col(hyp)).alias("char_edits"), F.length("ref").cast("long").alias("char_ref_len"))
    # both sides of a segment lie in one row here; `paired_positions` pairs two tables
    pairs = rows.select("source", F.col("ord").alias("pos"), edits("base").alias("base"), edits("hyp").alias("candidate"))
    out = stats.bootstrap_delta_ci(pairs, "source", method="poisson")
    return out.select("source", r6("lo").alias("lo"), r6("hi").alias("hi"), stats.verdict(F.col("lo"), F.col("hi")).alias("verdict"))


@query("""with s as (select label, i, avg(x) as x from (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings) group by all),
v as (select label, list(x order by i) as v from s group by label)
select a.label as label_a, b.label as label_b, round(list_sum([p[1] * p[2] for p in list_zip(a.v, b.v)]) / sqrt(list_sum([x * x for x in a.v]) * list_sum([x * x for x in b.v])), 6) as cosine from v a join v b on a.label < b.label""")
def pairwise_cosine(spark, sf_dir):
    cells = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    pairs = cells.alias("a").join(cells.alias("b"), F.expr("a.i = b.i and a.label < b.label"))  # one row for each label and place: as many as labels, not rows
    norms = cells.groupBy("label").agg(F.sum(F.col("x") * F.col("x")).alias("n"))
    dots = pairs.groupBy(F.col("a.label").alias("label_a"), F.col("b.label").alias("label_b")).agg(F.sum(F.expr("a.x * b.x")).alias("dot"))
    out = dots.join(norms.select(F.col("label").alias("label_a"), F.col("n").alias("na")), "label_a").join(norms.select(F.col("label").alias("label_b"), F.col("n").alias("nb")), "label_b")
    return out.select("label_a", "label_b", r6(F.col("dot") / F.sqrt(F.col("na") * F.col("nb"))).alias("cosine"))


@query("""select event_type, count(*) as n, count(json_extract_string(props, '$.k')) as n_k, count(distinct json_extract_string(props, '$.k')) as distinct_k from events group by event_type""")
def json_props(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(k).alias("n_k"), F.count_distinct(k).alias("distinct_k"))


@query(f"with {SEGMENTS} select source, round(sum(length(base)) / sum(length(ref)), 3) as length_ratio from segments group by source")
def length_ratio(spark, sf_dir):
    return scoring.length_ratio(segments(spark, sf_dir).select("source", "ref", F.col("base").alias("hyp")), "source")


@query("""select page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') as html from pages""")
def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.html_escape(F.col("html")).alias("html"))


@query("select doc_id, sha256(text) as sha256 from documents")
def checksum_rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query("""with h as (select doc_id::varchar as path, sha256(text) as have, sha256(case when lang = 'de' then lower(text) else text end) as want, source from documents)
select path, case when source = 'src0' then 'MISSING' else 'MISMATCH' end as status from h where source = 'src0' or have <> want""")
def checksum_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("path", F.col("doc_id").cast("string"))
    digest = lambda c: F.sha2(c.cast("binary"), 256).alias("sha256")
    expected = docs.select("path", digest(F.when(F.col("lang") == "de", F.lower("text")).otherwise(F.col("text"))))
    return checks.checksum_report(expected, docs.where("source <> 'src0'").select("path", digest(F.col("text"))))


_RESAMPLES = 200
_LOANS = "(select source, ord, t, count(*) filter (side = 'r') as r, count(*) filter (side = 'h') as h, count(*) filter (side = 'b') as b from toks group by all having count(*) filter (side = 'r') > 0)"
_GATED = f"""with recursive {SEGMENTS.strip()}, {edit_ctes('d')}, {edit_ctes('e', hyp='base')},
scored as materialized (select s.*, row_number() over (partition by source order by ord) - 1 as i, count(*) over (partition by source) as k, coalesce(d.edits, 0) as c, coalesce(e.edits, 0) as b, length(s.ref) as n
  from segments s left join d on s.ref = d.ref and s.hyp = d.hyp left join e on s.ref = e.ref and s.base = e.hyp),
sizes as (select distinct k, 32 - ceil(log2(k + 1))::int as low from scored),
{ot.twister(f"select {2 * _RESAMPLES} * max(k) + 9999 from sizes")},
drawn as (select k, y >> low as i, row_number() over (partition by k order by words.i) - 1 as d from sizes, words where y >> low < k),
sums as (select source, d // s.k as resample, sum(c) / sum(n) as c, sum(b) / sum(n) as b from drawn join scored s on drawn.k = s.k and drawn.i = s.i where d < {_RESAMPLES} * s.k group by all),
lists as (select source, list(c order by c) as c, list(b order by b) as b, list(b - c order by b - c) as d from sums group by source),
toks as (select source, ord, unnest({_TOKENS.format('ref')}) as t, 'r' as side from segments union all select source, ord, unnest({_TOKENS.format('hyp')}), 'h' from segments union all select source, ord, unnest({_TOKENS.format('base')}), 'b' from segments),
ret as (select source, sum(least(r, h)) / sum(r) as retention, sum(least(r, b)) / sum(r) as baseline_retention from {_LOANS} where {_LOAN} group by source),
g as (select source, count(*) as n_segments, sum(c) / sum(n) as cer, sum(b) / sum(n) as baseline_cer from scored group by source),
gated as (select source, n_segments, cer, c[6] as ci_lo, c[196] as ci_hi, baseline_cer, b[6] as baseline_ci_lo, b[196] as baseline_ci_hi, 0.9 * baseline_cer as bound, cer <= 0.9 * baseline_cer as pass,
  retention, baseline_retention, retention >= baseline_retention - 0.2 as retention_pass, d[6] as delta_lo, d[196] as delta_hi, case when d[6] > 0 then 'IMPROVED' when d[196] < 0 then 'REGRESSED' else 'INCONCLUSIVE' end as verdict
  from g join lists using (source) join ret using (source))"""
_ROUNDED = ("cer", "ci_lo", "ci_hi", "baseline_cer", "baseline_ci_lo", "baseline_ci_hi", "bound", "retention", "baseline_retention", "delta_lo", "delta_hi")


def _gate_sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = segments(spark, sf_dir)
    side = lambda hyp: stored(scoring.counted(rows.select("source", "ord", "ref", F.col(hyp).alias("hyp"))), "side")
    return side("hyp"), side("base")


def _gated(candidate: DataFrame, base: DataFrame) -> DataFrame:
    """The gate of each source, a slice of hundreds of segments or more: candidate and baseline are two tables that meet by position."""
    return gate.slice_gate(candidate, base, "source", 10, 0.2, scoring.retained_sums(candidate, ["source"]), scoring.retained_sums(base, ["source"]), resamples=_RESAMPLES)


@query(_GATED + f" select source, n_segments, {', '.join(f'round({c}, 6) as {c}' for c in _ROUNDED)}, pass, retention_pass, verdict from gated")
def paired_slice_gate(spark, sf_dir):
    return _gated(*_gate_sides(spark, sf_dir)).select("source", "n_segments", *[r6(c).alias(c) for c in _ROUNDED], "pass", "retention_pass", "verdict")


_REAL = """chunks as (select conv_id, turn, coalesce(text, '') as ref, case when turn = 0 then 'zz' || coalesce(text, '') else coalesce(text, '') end as hyp from conversations),
parents as (select conv_id, string_agg(ref, ' ' order by turn) as ref, string_agg(hyp, ' ' order by turn) as hyp from chunks group by conv_id)"""


@query(_GATED + f""", {_REAL}, {edit_ctes('pd', source='parents')},
r as (select sum(coalesce(pd.edits, 0)) / sum(length(p.ref)) as cer from parents p left join pd on p.ref = pd.ref and p.hyp = pd.hyp),
t as (select sum(c) / sum(n) as c, sum(b) / sum(n) as b from scored),
f as (select bool_and(coalesce(pass, true) and coalesce(retention_pass, true)) as fine from gated),
h as (select 'tier1_in_domain' as tier, t.c as cer, (0.9 * 0.01)::double as bound, t.c <= 0.9 * 0.01 and fine as pass from t, f union all select 'tier2_ood', t.b, 0.025::double, t.b <= 0.025 from t union all select 'tier4a_real', r.cer, 0.05::double, r.cer <= 0.05 from r)
select tier, round(cer, 6) as cer, round(bound, 6) as bound, pass from h union all select 'overall', null, null, bool_and(coalesce(pass, true)) from h""")
def run_gate(spark, sf_dir):
    """All tiers: in domain with its slices, out of domain, and real chunks that are rejoined first."""
    test, ood = _gate_sides(spark, sf_dir)
    turns = table(spark, sf_dir, "conversations")
    text = F.coalesce("text", F.lit(""))
    real = turns.select(F.col("conv_id").cast("string").alias("meeting_id"), F.format_string("seg_0000_%d", "turn").alias("segment_id"), F.col("turn").cast("long").alias("ord"), text.alias("ref"), F.when(F.col("turn") == 0, F.concat(F.lit("zz"), text)).otherwise(text).alias("hyp"))
    out = gate.run_gate(test, ood, real, {"cer_test": 0.01, "cer_ood": 0.005, "cer_real": 0.02}, 10, 0.02, 0.03, _gated(test, ood))
    return out.withColumns({"cer": r6("cer"), "bound": r6("bound")})


@query(_GATED + f""", {_REAL}, {edit_ctes('pd', source='parents')},
sides as (select 0.25 as w, source, count(*) as n_segments, sum(c) / sum(n) as cer from scored group by source union all select 0.5, source, count(*), sum(b) / sum(n) from scored group by source),
rt as (select conv_id, unnest({_TOKENS.format('ref')}) as t, 'r' as side from parents union all select conv_id, unnest({_TOKENS.format('hyp')}), 'h' from parents),
rr as (select sum(r)::double as n, sum(least(r, h)) as kept from (select conv_id, t, count(*) filter (side = 'r') as r, count(*) filter (side = 'h') as h from rt where {_LOAN} group by all) where r > 0),
ra as (select sum(coalesce(pd.edits, 0)) / sum(length(p.ref)) as cer, count(*) as n from parents p left join pd on p.ref = pd.ref and p.hyp = pd.hyp)
select w::double as lambda, source, s.n_segments, round(s.cer, 6) as cer, round(g.baseline_cer, 6) as baseline_cer, s.cer <= 0.9 * g.baseline_cer as pass,
  round(case w when 0.25 then ret.retention else ret.baseline_retention end, 6) as retention, case w when 0.25 then ret.retention else ret.baseline_retention end >= ret.baseline_retention - 0.2 as retention_pass
from sides s join g using (source) join ret using (source)
union all select 0.25, 'real', ra.n, round(ra.cer, 6), null, null, round(rr.kept / rr.n, 6), null from ra, rr union all select 0.5, 'real', ra.n, 0, null, null, 1, null from ra""")
def rescored_run(spark, sf_dir):
    """Another run's predictions at two weights, by source, and its real chunks."""
    rows = segments(spark, sf_dir)
    at = lambda w, hyp: rows.select(F.lit(w).alias("lambda"), "source", "ord", "ref", F.col(hyp).alias("hyp"))
    turns = table(spark, sf_dir, "conversations")
    text = F.coalesce("text", F.lit(""))
    said = lambda w, hyp: turns.select(F.lit(w).alias("lambda"), F.col("conv_id").cast("string").alias("meeting_id"), F.format_string("seg_0000_%d", "turn").alias("segment_id"), F.col("turn").cast("long").alias("ord"), text.alias("ref"), hyp.alias("hyp"))
    real = said(0.25, F.when(F.col("turn") == 0, F.concat(F.lit("zz"), text)).otherwise(text)).union(said(0.5, text))
    out = gate.rescored_run(at(0.25, "hyp").union(at(0.5, "base")), at(0.0, "base").drop("lambda"), [0.25, 0.5], 10, 0.2, real, method="poisson", resamples=20)
    return out.select("lambda", "source", "n_segments", *[r6(c).alias(c) for c in ("cer", "baseline_cer", "retention")], "pass", "retention_pass")


@query(f"""with t as (select source, doc_id, unnest({_TOKENS.format('lower(text)')}) as t, generate_subscripts({_TOKENS.format('lower(text)')}, 1) as p from documents),
c as (select t as token, count(*) as n, count(distinct source) as meetings, min((doc_id, p)) as f from t where {_LOAN} group by t having count(distinct source) >= 3)
select token, n, meetings, row_number() over (order by n desc, f)::int as rank from c order by n desc, f limit 25""")
def top_vocabulary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.lower("text").alias("text"))
    return corpus.top_vocabulary(docs, "text", "source", order="doc_id")
