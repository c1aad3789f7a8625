"""Dense places of scans, and CSV records over the borders of splits."""

import csv
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lectern.sources import quoted, readers, schemas, writers


@pytest.fixture
def split_bytes(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {k: spark.conf.get(k) for k in keys}

    def put(most, cost=0):
        spark.conf.set(keys[0], most)
        spark.conf.set(keys[1], cost)

    yield put
    for k, v in old.items():
        spark.conf.set(k, v)


def sentences(folder, files, rows, group):
    n = 0
    for f in range(files):
        texts = [f"t{n + i} " + "x" * 40 for i in range(rows)]
        n += rows
        pq.write_table(pa.table({"sentence": texts}), f"{folder}/part-{f:03d}.parquet", row_group_size=group)
    return [f"t{i} " + "x" * 40 for i in range(n)]


@pytest.mark.parametrize(("files", "rows", "group", "most"), [(3, 4, 4, 1 << 27), (9, 5, 5, 1 << 27), (2, 400, 20, 3000), (5, 300, 50, 2000), (1, 1000, 100, 4000)])
def test_utterance_ids_are_dense(spark, tmp_path, split_bytes, files, rows, group, most):
    """Several files in one task, and files of several row groups over several tasks."""
    texts = sentences(tmp_path, files, rows, group)
    split_bytes(most)
    got = readers.read_utterances(spark, str(tmp_path), "test")
    assert [(r.segment_id, r.text, r.ord) for r in sorted(got.collect(), key=lambda r: r.ord)] == [(f"utt_test_{i:05d}", t, i) for i, t in enumerate(texts)]
    first = readers.read_utterances(spark, str(tmp_path), "test", limit=7).collect()
    assert sorted(r.ord for r in first) == list(range(7))
    text = got._jdf.queryExecution().executedPlan().toString()
    # only counts are shuffled and sorted, no rows
    assert "SortMergeJoin" not in text and "sentence" not in "".join(line for line in text.splitlines() if "Exchange" in line)


def test_places_of_json_lines(spark, tmp_path, split_bytes):
    n = 0
    for f in range(4):
        lines = []
        for i in range(60 * f):
            lines += [f'{{"segment_id": "{n}", "text": "{"y" * (n % 50)}"}}', *[""] * (n % 3 == 0)]
            n += 1
        (tmp_path / f"manifest.{f}.jsonl").write_text("\n".join(lines))
    split_bytes(1500)
    rows = spark.read.schema(schemas.SEGMENT).json(str(tmp_path))
    assert rows.rdd.getNumPartitions() > 6
    got = readers.in_place_order(rows).select("segment_id", "place").collect()
    assert sorted((r.place, int(r.segment_id)) for r in got) == [(i, i) for i in range(n)]


def cells(rng):
    return rng.choice(["", "plain", "a,b", 'say "x"', "line\nbreak", '"\n', "\n\n", 'tail"', "é\n日本", ",", "z" * 60, "\r\nq"])


@pytest.mark.parametrize("most", [40, 333, 5000])
def test_quoted_records_over_split_borders(spark, tmp_path, split_bytes, most):
    rng = random.Random(most)
    rows = []
    for f in range(3):
        own = [(f"s{f}_{i}", cells(rng) or "m", cells(rng), cells(rng)) for i in range(0 if f == 1 else 70)]
        rows += own
        with open(tmp_path / f"p{f}.csv", "w", newline="", encoding="utf-8") as out:
            w = csv.writer(out, lineterminator="\r\n" if f == 2 else "\n")
            w.writerow(["segment_id", "meeting_id", "ref", "hyp"])
            w.writerows(own)
    split_bytes(most)
    back = readers.read_predictions(spark, str(tmp_path))
    got = sorted(back.collect(), key=lambda r: r.ord)
    plain = lambda t: t.replace("\r\n", "\n")
    assert [(r.segment_id, plain(r.meeting_id), plain(r.ref), plain(r.hyp)) for r in got] == [tuple(map(plain, r)) for r in rows]
    assert len({r.ord for r in got}) == len(rows)
    split_bytes(1 << 27)
    whole = readers.in_file_order(readers.read_csv(spark, str(tmp_path), schemas.PREDICTION)).na.fill("")
    # the whole-file reader turns line ends within cells of a \r\n file into \n
    both = [[tuple(map(plain, (r.segment_id, r.meeting_id, r.ref, r.hyp))) for r in rows] for rows in (got, sorted(whole.collect(), key=lambda r: r.ord))]
    assert both[0] == both[1]


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path, split_bytes):
    path = str(tmp_path / "one")
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("segment_id"), F.lit("m").alias("meeting_id"), F.concat(F.lit('a "q",\n'), "id").alias("ref"), F.repeat(F.lit("long\n"), 30).alias("hyp")).coalesce(1)
    writers.write_predictions(rows, path)
    split_bytes(1 << 18)
    back = readers.read_predictions(spark, path)
    by_task = back.where("ord >= 0").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in by_task) == 20_000 and sum(r.n > 500 for r in by_task) > 8
    assert back.agg(F.sum(F.length("hyp"))).first()[0] == 150 * 20_000
    assert [r.segment_id for r in back.orderBy("ord").limit(3).collect()] == ["0", "1", "2"]


def test_quoted_reader_refuses_what_it_cannot_read(spark, tmp_path):
    for name, text in {"header": "segment_id,other,ref,hyp\n1,2,3,4\n", "many": "segment_id,meeting_id,ref,hyp\n1,2,3,4,5\n", "few": "segment_id,meeting_id,ref,hyp\n1,2\n"}.items():
        (tmp_path / f"{name}.csv").write_text(text)
        with pytest.raises(Exception, match="not the header|MALFORMED|FAILFAST"):
            readers.read_predictions(spark, str(tmp_path / f"{name}.csv")).collect()
    (tmp_path / "empty.csv").write_text("segment_id,meeting_id,ref,hyp\n\n")
    assert readers.read_predictions(spark, str(tmp_path / "empty.csv")).count() == 0
    assert quoted.records(spark, str(tmp_path / "empty.csv")).count() == 1
