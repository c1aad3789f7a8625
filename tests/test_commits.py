import os

import pytest
from pyspark.sql import functions as F

from lectern.operators import commits
from lectern.operators.checks import IntegrityError

SCHEMA = "id int, meeting string, split string, n int"
KEYS = {"meeting in two splits": ("meeting", "split")}


def row_rules():
    return {"negative": F.col("n") < 0, "huge": F.col("n") > 1000}


def test_clean_rows_are_read_once_and_committed(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def through(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    rows = spark.createDataFrame([(i, f"m{i % 5}", "train" if i % 5 else "test", i) for i in range(100)], SCHEMA).mapInPandas(through, SCHEMA)
    path = tmp_path / "corpus"
    path.mkdir()  # empty is fine
    assert commits.write_checked(rows, f"file://{path}", "id", row_rules(), KEYS) == 100
    assert read.value == 100
    assert spark.read.parquet(str(path)).count() == 100
    assert os.listdir(tmp_path) == ["corpus"]
    with pytest.raises(IntegrityError, match="not empty"):
        commits.write_checked(rows, f"file://{path}", "id", row_rules(), KEYS)


def test_every_broken_rule_is_named_and_nothing_is_left(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "train", -1), (2, "a", "test", 5), (3, "b", None, 2000), (4, "b", "x", 3000), (5, None, "x", None), (6, None, "y", 1)], SCHEMA)
    with pytest.raises(IntegrityError) as e:
        commits.write_checked(rows, f"file://{tmp_path}/corpus", "id", row_rules(), KEYS)
    assert all(part in str(e.value) for part in ("negative: 1 (first 1)", "huge: 2 (first 3)", "meeting in two splits: 2"))
    assert os.listdir(tmp_path) == []


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "x", 1)], SCHEMA).withColumn("n", F.raise_error(F.lit("broken")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        commits.write_checked(rows, f"file://{tmp_path}/corpus", "id", row_rules())
    assert os.listdir(tmp_path) == []


def test_empty_tables_and_names(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    report = commits.draft(empty, f"file://{tmp_path}/d", "id", row_rules(), KEYS)
    assert sorted(map(tuple, report.collect())) == [("huge", 0, None), ("meeting in two splits", 0, None), ("negative", 0, None), ("rows", 0, None)]
    with pytest.raises(ValueError, match="twice"):
        commits.draft(empty, f"file://{tmp_path}/e", "id", {"rows": F.lit(True)})
