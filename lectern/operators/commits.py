"""All integrity rules of a corpus beside its write; it becomes visible only if every rule holds.

Rules about single rows are counted by `observe` while the rows are written, so the source is read once. Rules about keys
need the rows of a key together: they are one aggregate over the few columns that they name, read back from what was written.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lectern.operators.checks import IntegrityError, destination_empty

REPORT = "rule string, n long, example string"


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def draft(frame: DataFrame, path: str, example: str, rows: Mapping[str, Column], keys: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """frame written to path, and (rule, n, example): how many rows or keys break each rule, and the least example.

    rows: rule -> condition that is true on a row that breaks it; null breaks nothing. keys: rule -> (key, value) columns,
    broken by a key with more than one value; nulls are no value, a null key is one key. example: the column that names a
    row. A row of rule `rows` has the number of rows written and no example. The report has a row for each rule.
    """
    spark, names = frame.sparkSession, list(rows)
    every = ["rows", *names, *(keys or {})]
    if clash := {rule for rule in every if every.count(rule) > 1}:
        raise ValueError(f"rules named twice: {sorted(clash)}")
    seen = Observation()
    measures = [F.count(F.lit(1)).alias("n")]
    for i, rule in enumerate(names):
        measures += [F.count_if(rows[rule]).alias(f"n{i}"), F.min(F.when(rows[rule], F.col(example).cast("string"))).alias(f"e{i}")]
    frame.observe(seen, *measures).write.parquet(path)
    found = seen.get
    report = [("rows", found["n"], None), *((rule, found[f"n{i}"], found[f"e{i}"]) for i, rule in enumerate(names))]
    out = spark.createDataFrame(report, REPORT)
    if not keys:
        return out
    text = lambda c: F.col(c).cast("string")
    pairs = F.array(*[F.struct(F.lit(rule).alias("rule"), text(k).alias("key"), text(v).alias("value")) for rule, (k, v) in keys.items()])
    each = spark.read.schema(frame.schema).parquet(path).select(F.inline(pairs))
    several = each.groupBy("rule", "key").agg((F.min("value") < F.max("value")).alias("broken")).where("broken")
    broken = several.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("example"))
    named = spark.createDataFrame([(rule,) for rule in keys], "rule string")
    return out.union(named.join(broken, "rule", "left").select("rule", F.coalesce("n", F.lit(0)), "example"))


def write_checked(frame: DataFrame, path: str, example: str, rows: Mapping[str, Column], keys: Mapping[str, tuple[str, str]] | None = None) -> int:
    """The number of rows written to path, which must be empty or absent, if no rule of `draft` is broken; else an error
    that names every broken rule, and nothing at path. The draft lies beside path and gets its name in one step."""
    spark = frame.sparkSession
    destination_empty(spark, path)
    beside = f"{path.rstrip('/')}.draft-{uuid.uuid4().hex}"
    source, files = _files(spark, beside)
    try:
        report = {r.rule: r for r in draft(frame, beside, example, rows, keys).collect()}  # a row for each rule
        n = report.pop("rows").n
        if faults := [f"{r.rule}: {r.n} (first {r.example})" for r in report.values() if r.n]:
            raise IntegrityError("; ".join(faults))
        target, _ = _files(spark, path)
        if files.exists(target):
            files.delete(target, False)  # empty, or it fails
        if not files.rename(source, target):
            raise OSError(f"cannot commit {path}")
    finally:
        files.delete(source, True)
    return n
