"""Integrity rules. Each returns its violations as rows; `enforce` turns any into an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as tx

MAX_SPEECH_RATE, MAX_SECONDS = 60.0, 30.0


class IntegrityError(ValueError):
    """A rule is violated."""


def enforce(violations: DataFrame, rule: str, shown: int = 5) -> None:
    """Raise with the first few violations, if there are any; only those come to the driver."""
    if rows := violations.limit(shown).collect():
        raise IntegrityError(f"{rule}: " + "; ".join(str(r.asDict()) for r in rows))


def in_several(frame: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value: a meeting in two splits, an id in two sources."""
    return frame.groupBy(key).agg(F.count_distinct(value).alias("n")).where("n > 1")


def top_directory(path):
    return F.substring_index(path, "/", 1)


def unverified(records: DataFrame, source: str = "source") -> DataFrame:
    """Records not verified, of sources where any record has the field at all."""
    gated = records.groupBy(source).agg(F.max(F.col("verified").isNotNull()).alias("gated")).where("gated").select(source)
    return records.join(gated, source, "left_semi").where(~F.coalesce("verified", F.lit(False)))


def unverified_summary(records: DataFrame, key: str, shown: int = 10) -> DataFrame:
    """(n, examples): how many are not verified, and the first ids."""
    rows = records.where(~F.coalesce("verified", F.lit(False)))
    first = rows.select(key).orderBy(key).limit(shown).agg(F.array_sort(F.collect_list(key)).alias("examples"))
    return rows.agg(F.count("*").alias("n")).crossJoin(first)  # one row each


def too_fast(segments: DataFrame, limit: float = MAX_SPEECH_RATE) -> DataFrame:
    return segments.withColumn("rate", tx.speech_rate(F.col("text"), F.col("duration"))).where(F.col("rate") > limit)


def too_long(segments: DataFrame, limit: float = MAX_SECONDS) -> DataFrame:
    return segments.where(F.col("duration") > limit)


def totals(segments: DataFrame, limit: float = MAX_SECONDS) -> DataFrame:
    """One row: segments, how many are too long, and all characters of text."""
    return segments.agg(F.count("*").alias("segments"), F.count_if(F.col("duration") > limit).alias("too_long"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))


def destination_empty(spark: SparkSession, path: str) -> None:
    """Raise where the folder has anything in it already."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(where) and len(store.listStatus(where)):
        raise IntegrityError(f"{path} is not empty; nothing is written into it")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def missing(wanted: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """Rows of wanted whose key `there` lacks."""
    return wanted.join(there.select(key).distinct(), key, "left_anti")


def checksum_report(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, status): files that are MISSING or MISMATCH; files that nobody listed are passed over."""
    joined = expected.select("path", F.col("sha256").alias("want")).join(actual.select("path", F.col("sha256").alias("have")), "path", "left")
    status = F.when(F.col("have").isNull(), "MISSING").when(F.col("have") != F.col("want"), "MISMATCH")
    return joined.select("path", status.alias("status")).where("status is not null")


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str, text: str, least_chars: int = 0) -> DataFrame:
    """(key, n_sentences): how many lines and sentences of a document the benchmark has too, full stops and spaces at
    their ends aside. least_chars: shorter sentences don't count."""
    cut = lambda rows, *keys: rows.select(*keys, F.explode(F.split(text, r"\n|\. ")).alias("s")).select(*keys, F.btrim("s", F.lit(" .")).alias("sentence")).where(f"sentence <> '' and length(sentence) >= {int(least_chars)}")
    known = cut(benchmark).distinct()
    return cut(docs, key).join(known, "sentence", "left_semi").groupBy(key).agg(F.count("*").alias("n_sentences"))


def lookup_near(rows: DataFrame, value: str, wanted: float, tolerance: float = 1e-9) -> DataFrame:
    """The first row whose value lies within the tolerance of `wanted`; none is an error."""
    found = rows.where(F.abs(F.col(value) - wanted) < tolerance).orderBy(value).limit(1)
    if not found.head(1):
        raise IntegrityError(f"no row with {value} = {wanted}")
    return found
