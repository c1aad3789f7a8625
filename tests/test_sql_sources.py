import json
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import timeline
from lectern.sources import readers, sql


def manifests(folder):
    rng = random.Random(2)
    for name in ("manifest.b.jsonl", "manifest.a.jsonl"):
        rows = [{"segment_id": f"{name[9]}{i}", "split": rng.choice(["train", "test"]), "text": "đỏ \n x" * rng.randint(0, 9), "duration": i / 2, "more": [1]} for i in range(60)]
        lines = [json.dumps(r, ensure_ascii=False) + ("\n\n" if i % 9 == 0 else "\n") for i, r in enumerate(rows)]
        (folder / name).write_text("".join(lines).rstrip("\n") + ("\n" if name[9] == "a" else ""), encoding="utf-8")
    (folder / "other.json").write_text("{}")


@pytest.mark.parametrize("size", [7, 100, 1 << 20])
def test_splits_give_the_rows_of_the_reader(spark, tmp_path, size):
    manifests(tmp_path)
    sql.register(spark)
    got = spark.read.format("manifests").option("split", size).load(f"file://{tmp_path}").orderBy("ord").drop("ord")
    wanted = readers.read_manifests(spark, f"file://{tmp_path}").orderBy("ord").drop("ord").select(*got.columns)
    assert got.collect() == wanted.collect()


def test_filters_are_tested_in_the_source(spark, tmp_path):
    manifests(tmp_path)
    sql.register(spark)
    rows = spark.read.format("manifests").load(f"file://{tmp_path}").where("split = 'train' and duration > 3")
    wanted = readers.read_manifests(spark, f"file://{tmp_path}").where("split = 'train' and duration > 3")
    assert rows.count() == wanted.count() > 0
    filters = [line for line in rows._jdf.queryExecution().executedPlan().toString().splitlines() if "Filter" in line]
    assert all("train" not in line.split("PushedFilters")[0] for line in filters)


def test_no_file_is_an_error(spark, tmp_path):
    sql.register(spark)
    with pytest.raises(Exception, match="no manifest"):
        spark.read.format("manifests").load(f"file://{tmp_path}").count()


def test_cuts_equal_the_fold(spark):
    rng = random.Random(4)
    rows = [(key, rng.uniform(0, 400)) for key in ("a", "b") for _ in range(80)] + [("one", 95.0), ("none", None)]
    words = spark.createDataFrame(rows, "key string, start double")
    words.createOrReplaceTempView("words_of_test")
    sql.register(spark)
    got = spark.sql("select * from greedy_cuts(2.0D, 30.0D, 5.0D, 1.5D, table(words_of_test) partition by key order by start)")
    there = words.where("start is not null").withColumn("ord", F.col("start"))
    durations = there.groupBy("key").agg((F.max("start") + 1.5).alias("duration"))
    wanted = timeline.greedy_cut_rows(timeline.gap_candidates(there, "key", 2.0), durations, "key", 30.0, 5.0)
    show = lambda frame: sorted((r.key, r.i, round(r.cut, 9)) for r in frame.collect())
    assert show(got) == show(wanted)
