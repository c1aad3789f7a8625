"""Queries over keys and sizes that the small tables don't have."""

import time
from decimal import Decimal

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
from lectern.functions import text
from lectern.functions.numbers_vi import words_to_digits
from lectern.operators import corpus, gate, scoring, stats


def tables(tmp_path, **queries):
    """A folder of tables made by SQL."""
    for name, sql in queries.items():
        duckdb.execute(f"copy ({sql}) to '{tmp_path}/{name}.parquet' (format parquet)")
    return str(tmp_path)


def plain(row):
    return tuple(float(v) if isinstance(v, Decimal) else v for v in row)


def matches(spark, name, folder):
    """The query's rows, which are its SQL's."""
    got = entry.queries()[name](spark, folder)
    with duckdb.connect() as db:
        for table in ("supplier", "orders", "events", "lineitem", "documents", "conversations"):
            if duckdb.sql(f"select count(*) from glob('{folder}/{table}.parquet')").fetchall()[0][0]:
                db.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
        found = db.execute(entry.oracle_sql()[name])
        columns = [c[0] for c in found.description]
        want = sorted((plain(r) for r in found.fetchall()), key=repr)
    rows = sorted((plain(r) for r in got.select(*columns).collect()), key=repr)
    assert rows == want
    return rows


SUPPLIERS = "select i as s_suppkey, 'name ' || i as s_name, i / 4 as s_acctbal from range({}) t(i)"


@pytest.mark.parametrize("name", ["ingest_delivery", "ingest_summary"])
def test_deliveries_with_keys_of_five_digits(spark, tmp_path, name):
    matches(spark, name, tables(tmp_path, supplier=SUPPLIERS.format(10020), orders="select i as o_orderkey, i % 40 as o_custkey from range(100) t(i)"))


def test_places_of_sources_over_several_splits(spark, tmp_path):
    folder = tables(tmp_path, supplier=SUPPLIERS.format(3000))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert len(matches(spark, "sources_roundtrip", folder)) == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_tokens_are_judged_above_the_aggregate(spark):
    """The loanword test runs once for each distinct token, and a row of it for each segment is not handed on."""
    rows = spark.createDataFrame([("a", i, "zeta zeta alpha beta", "zeta alpha beta alpha") for i in range(50)], "source string, ord long, ref string, hyp string").coalesce(1)
    sums = scoring.retained_sums(rows, ["source"])
    assert sorted(map(tuple, sums.collect())) == [("a", "alpha", 50, 50), ("a", "beta", 50, 50), ("a", "zeta", 100, 50)]
    whole = scoring.retained_tokens(rows, ["source", "ord"])
    lost = scoring.retained_tokens(rows, ["source", "ord"], lost=True)
    assert whole.count() == 150 and {tuple(r)[2:] for r in lost.collect()} == {("zeta", 2, 1, 0)}
    docs = rows.select("source", "ord", F.col("ref").alias("text"))
    for frame in (scoring.retention_by(sums, "source"), scoring.missing_tokens(lost), corpus.token_vocabulary(docs, "text", "source", 1), corpus.top_vocabulary(docs, "text", "source", least=1), corpus.top_tokens(docs, "text", 3)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        judged = next(i for i, line in enumerate(plan.splitlines()) if scoring.tx.SYLLABLE[:20] in line and "Filter" in line)
        assert judged < next(i for i, line in enumerate(plan.splitlines()) if "Aggregate [" in line and "token" in line.split("]")[0])


def test_few_texts_of_a_batch_are_python_strings(spark):
    sizes = []
    texts = pa.array(["một hai", None, "é"] * 100)
    out = text.in_parts(texts, lambda part: sizes.append(len(part)) or pa.array(part, pa.string()))
    assert out.equals(texts) and max(sizes) <= text.AT_ONCE < sum(sizes) == 300
    assert text.in_parts(pa.array([], pa.string()), lambda part: pa.array(part, pa.string())).type == pa.string()
    rows = spark.createDataFrame([(t,) for t in texts.to_pylist()[:3]], "t string").coalesce(1)
    found = rows.select(text.nfc(F.col("t")).alias("n"), words_to_digits(F.col("t")).alias("d")).collect()
    assert [(r.n, r.d.text, r.d.n_conversions) for r in found] == [("một hai", "12", 1), (None, None, None), ("é", "é", 0)]


def test_texts_are_normalised_once(spark):
    """Counts and text of one normalisation come from one pass: no step of it stands in the plan twice."""
    rows = spark.createDataFrame([("Ừm, hai  mươi　ừm\x1cngười; không",), ("linh (lẻ) năm lẻ\x85ỪM",), ("",), (None,)], "t string").coalesce(1)
    done = rows.select(text.Normalizer(filler_tokens=("ừm",)).audited(F.col("t")).alias("d")).select("d.text", "d.conversions", "d.fillers_removed")
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(step) for step in ("lower(", "translate(", "words_to_digits(", "_nfc(", "regexp_replace(")] == [1, 1, 1, 1, 0]
    assert list(map(tuple, done.collect())) == [("20 người không", 1, 2), ("5 lẻ", 1, 1), ("", 0, 0), (None, None, None)]
    marks = text.PUNCTUATION
    assert [r.v for r in rows.limit(1).select(text.normalize(F.lit("a".join(marks))).alias("v")).collect()] == [" ".join("a" * (len(marks) - 1))]


def test_sums_of_tokens_are_held_over_batches(spark):
    """A task hands on one row for each token, however many Arrow batches it has; null texts and other hypotheses count as before."""
    rows = spark.createDataFrame([(None if i % 2 else "a", i, "zeta zeta alpha", None if i % 10 == 8 else "zeta alpha" if i % 4 == 0 else "zeta zeta alpha") for i in range(200)], "source string, ord long, ref string, hyp string").coalesce(1)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(map(tuple, scoring.retained_sums(rows, ["source"]).collect()), key=repr)
        whole = scoring.retained_sums(rows.drop("source"), []).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert got == [("a", "alpha", 80, 80), ("a", "zeta", 160, 120), (None, "alpha", 100, 100), (None, "zeta", 200, 200)]
    assert sorted(map(tuple, whole)) == [("alpha", 180, 180), ("zeta", 360, 320)]


def test_counts_of_draws_take_no_longer_as_bytes():
    """Bytes took five times as long, as each one was cast by itself."""
    k, seconds, counts = 600_000, {}, {}
    for kind in (np.int64, np.uint8):
        drawn, began = stats.Draws(k), time.monotonic()
        counts[kind] = [drawn.counts(kind) for _ in range(4)]
        seconds[kind] = time.monotonic() - began
    assert all((a == b).all() for a, b in zip(*counts.values(), strict=True)) and seconds[np.uint8] < 3 * seconds[np.int64]


def test_rescored_run_with_a_long_meeting(spark):
    """The table of 120,000 by 120,000 characters would take minutes; the base's tokens are counted once for all weights."""
    text = "họp of the report " * 6700
    base = spark.createDataFrame([("a", i, "report alpha", "report") for i in range(4)], "source string, ord long, ref string, hyp string")
    runs = base.withColumn("hyp", F.col("ref")).withColumn("lambda", F.explode(F.array(F.lit(0.25), F.lit(0.5))))
    real = spark.createDataFrame([(w, "m", "seg_0000", 0, text, hyp) for w, hyp in ((0.25, "zz" + text), (0.5, text.replace("of the ", "of te ")))], "lambda double, meeting_id string, segment_id string, ord long, ref string, hyp string")
    began = time.monotonic()
    rows = gate.rescored_run(runs, base, [0.25, 0.5], 10, 0.2, real, method="poisson", resamples=4).collect()
    assert time.monotonic() - began < 90
    assert sorted((r["lambda"], r.source, r.n_segments, r.retention, r.baseline_retention) for r in rows if r.source == "a") == [(w, "a", 4, 1.0, 0.5) for w in (0.25, 0.5)]
    assert {r["lambda"]: r.cer for r in rows if r.source == "real"} == {0.25: 2 / len(text), 0.5: 6700 / len(text)}
