import gzip
import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import captions, checks, corpus, timeline
from lectern.sources import readers, schemas, writers


def records(spark, rows):
    return spark.createDataFrame(rows, "segment_id string, meeting_id string, split string, source string, duration double, text string, verified boolean, ord long")


ROWS = [
    ("s0", "paid_0001", "demo", "synthetic", 60.0, "một hai", None, 0),
    ("s1", "paid_0001", "demo", "synthetic", 60.0, "report này", None, 1),
    ("s2", "paid_0002", "test", "synthetic", 30.0, "x", None, 2),
    ("s3", "videoA", "demo", "youtube", 120.0, "report", True, 3),
    ("s4", "videoB", "test", "youtube", 30.0, "y", False, 4),
]


def test_splits(spark):
    frame = corpus.resolve_splits(records(spark, ROWS), ["videoA"])
    assert corpus.split_counts(frame).first().asDict() == {"train": 2, "val": 1, "test": 2}
    assert checks.in_several(frame, "meeting_id", "split").count() == 0
    conflict = records(spark, [("a", "m1", "demo", "s", 1.0, "", None, 0), ("b", "m1", "test", "s", 1.0, "", None, 1)])
    bad = checks.in_several(corpus.resolve_splits(conflict, []), "meeting_id", "split")
    with pytest.raises(checks.IntegrityError, match="m1"):
        checks.enforce(bad, "one split for each meeting")
    with pytest.raises(Exception, match="unknown split"):
        corpus.resolve_splits(records(spark, [("a", "m", "dev", "s", 1.0, "", None, 0)]), []).collect()


def test_new_batch_names(spark):
    frame = spark.createDataFrame([("train", "rec_07", "a/rec_07/rec_07.wav")], "split string, m string, p string")
    row = frame.select(corpus.remap_new_batch(F.col("split")).alias("s"), corpus.renamed_meeting(F.col("m"), r"rec_(\d+)", "paid_%s").alias("m"), corpus.replace_first(F.col("p"), F.col("m"), F.lit("paid_07")).alias("p")).first()
    assert tuple(row) == ("demo", "paid_07", "a/paid_07/rec_07.wav")
    with pytest.raises(Exception, match="unexpected meeting"):
        frame.select(corpus.renamed_meeting(F.lit("zzz"), r"rec_(\d+)", "paid_%s")).collect()


def test_reports(spark):
    frame = records(spark, ROWS)
    report = {(r.split, r.source): (r.segments, r.minutes, r.percent) for r in corpus.split_source_report(frame).collect()}
    assert report["demo", "synthetic"] == (2, 2.0, 50.0) and report["test", "youtube"] == (1, 0.5, 50.0)
    assert corpus.label_summary(frame, "source").first().labels == "synthetic, youtube"
    assert corpus.label_summary(frame.where("false"), "source").first().labels == "n/a"
    assert [r.line for r in corpus.provenance_markdown(corpus.source_totals(frame, "source", "duration")).orderBy("line").collect()] == ["| synthetic | 3 | 2.5 |", "| youtube | 2 | 2.5 |"]
    assert [tuple(r) for r in corpus.token_vocabulary(frame, "text", "meeting_id", 2).collect()] == [("report", 2, 2)]
    bins = spark.createDataFrame([(2.9,), (3.0,), (22.5,), (23.0,), (23.1,)], "v double")
    assert sorted(tuple(r) for r in corpus.histogram(bins, F.col("v"), 3, 23).collect()) == [(3, 1), (22, 2)]
    words = spark.createDataFrame([("vâng report 12 [Âm nhạc] đi, đi. đi đi đi",)], "text string")
    row = corpus.text_stats(words, "text").first()
    assert (row.n_words, row.n_labels) == (10, 1) and row.lexical_particle_rate == 0.1 and row.digit_word_rate == 0.1 and row.punctuation_per_100_words == 20.0


def test_merge_and_integrity(spark):
    frame = records(spark, ROWS)
    merged = corpus.merge_sources(frame, frame.drop("verified"))
    assert merged.count() == 10 and merged.where("verified is null").count() == 8
    assert checks.unverified(frame).select("segment_id").collect()[0][0] == "s4"
    assert tuple(checks.unverified_summary(frame, "segment_id", 2).first()) == (4, ["s0", "s1"])
    assert checks.too_long(frame).count() == 3
    fast = spark.createDataFrame([("x" * 61, 1.0), ("x", 0.0), ("x", 1.0)], "text string, duration double")
    assert checks.too_fast(fast).count() == 2
    assert checks.overlap(frame, frame.where("ord < 2"), "segment_id").count() == 2
    assert checks.missing(frame, frame.where("ord < 2"), "segment_id").count() == 3
    sweep = spark.createDataFrame([(0.25, 1.0), (0.5, 2.0)], "lambda double, v double")
    assert checks.lookup_near(sweep, "lambda", 0.5 + 1e-12).first().v == 2.0
    with pytest.raises(checks.IntegrityError):
        checks.lookup_near(sweep, "lambda", 0.3)


def test_corrections(spark):
    frame = records(spark, ROWS[:2])
    fixes = spark.createDataFrame([("s0", "a"), ("s1", "b"), ("s9", "c")], "segment_id string, text string")
    rows = corpus.apply_corrections(frame, fixes, "me", "2026-01-01").orderBy("ord").collect()
    assert [(r.text, r.verified, r.review_date) for r in rows] == [("a", True, "2026-01-01"), ("b", True, "2026-01-01")]
    for bad in (fixes.where("segment_id = 's0'"), fixes.replace("b", "  ")):
        with pytest.raises(Exception, match="no correction"):
            corpus.apply_corrections(frame, bad).collect()
    assert [r.text for r in corpus.corrected_subset(frame, fixes, ["s1"], 5).collect()] == ["a"]
    with pytest.raises(Exception, match="open mark"):
        corpus.corrected_subset(frame, fixes.replace("a", "a <??>"), [], 0).collect()


def test_scans_keep_the_order_over_many_splits(spark, tmp_path):
    """The shortest rows, split finely, in files of several sizes; nothing is shuffled for it."""
    for name, n in (("a", 3000), ("b", 10), ("c", 5000)):
        (tmp_path / f"manifest.{name}.jsonl").write_text("".join("{}\n" if i % 3 else f'{{"text":"{name}{i:04d}"}}\n\n' for i in range(n)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = readers.read_manifests(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 20 and "Exchange hash" not in rows._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.ord, r.text) for r in rows.collect())
        spark.conf.set("spark.sql.files.maxPartitionNum", "4")
        with pytest.raises(ValueError, match="order"):
            readers.read_manifests(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was[0])
        spark.conf.set("spark.sql.files.openCostInBytes", was[1])
        spark.conf.unset("spark.sql.files.maxPartitionNum")
    assert [t for _, t in got] == [f"{name}{i:04d}" if i % 3 == 0 else None for name, n in (("a", 3000), ("b", 10), ("c", 5000)) for i in range(n)]
    assert len({o for o, _ in got}) == len(got)


def test_captions(spark):
    def screened(tracks):
        row = captions.screen(spark.createDataFrame([(tracks,)], schemas.CAPTIONS)).first()
        return row.ok, row.rule, row.track

    entry = lambda name: [("json3", name, "u")]
    assert screened({"vi": entry("Vietnamese (Original)"), "en": entry("English")}) == (True, None, "vi")
    assert screened({"en": entry("English (Original)")}) == (False, 1, None)
    assert screened({"vi": entry("Vietnamese"), "en": entry("English (Original)")}) == (False, 2, None)
    assert screened(None) == (False, 1, None)
    tries = spark.createDataFrame([("v", 0, 2), ("v", 1, 5), ("v", 2, 5)], "id string, attempt int, n_tracks int")
    assert tuple(captions.richest_attempt(tries, "id").first()) == ("v", 1, 5)
    owned = spark.createDataFrame([({"vi": entry("a"), "en": entry("b")},), ({"ja": entry("a"), "en": entry("b")},), ({},)], schemas.CAPTIONS)
    assert [r[0] for r in owned.select(captions.owner_keys(F.col("automatic_captions"))).collect()] == [["vi"], ["en", "ja"], []]


def test_third_rule_of_the_screen(spark):
    rows = [("thin", True, None, "accepted", "vi"), ("even", True, None, "accepted", "vi"), ("out", False, 2, "no", None), ("bare", True, None, "accepted", "vi")]
    screened = spark.createDataFrame(rows, "id string, ok boolean, rule int, reason string, track string")
    pace = timeline.pace(spark.createDataFrame([("thin", 0, 0.0), ("thin", 1, 845.0), ("thin", 2, 160.0), ("even", 0, 845.0), ("even", 1, 800.0), ("out", 0, 9.0), ("out", 1, 1.0)], "id string, i int, wpm double"), "id")
    got = {r.id: (r.ok, r.rule, r.reason, r.track) for r in captions.screen_pace(screened, pace, "id").collect()}
    assert got == {"thin": (False, 3, "words a minute fall from 845 to 160", "vi"), "even": (True, None, "accepted", "vi"), "out": (False, 2, "no", None), "bare": (True, None, "accepted", "vi")}
    docs = spark.createDataFrame([("a", [(0, 1, [("x", None, None), ("y", 0, None)]), (None, None, None)]), ("b", None)], f"id string, {schemas.JSON3}")
    assert sorted(map(tuple, timeline.timing_counts(docs, "id").collect())) == [("a", 2, 2, 1), ("b", 0, 0, 0)]


def test_split_of_one_source(spark):
    rows = spark.createDataFrame([(0, "test", "youtube"), (1, "test", "paid"), (2, "train", "youtube")], "ord int, split string, source string")
    assert [r.ord for r in corpus.split_of_source(rows, "test", "youtube").collect()] == [0]
    assert [r.ord for r in corpus.only_split(rows, "test", 1).collect()] == [0] and corpus.first_of(rows, 0).count() == 3
    with pytest.raises(ValueError):
        corpus.split_of_source(rows, "val", "youtube")


def test_manifest_files(spark, tmp_path):
    (tmp_path / "manifest.b.jsonl").write_text('{"segment_id":"b0","text":"à"}\n\n{"segment_id":"b1","text":"x"}\n', encoding="utf-8")
    (tmp_path / "manifest.a.jsonl").write_text('{"segment_id":"a0","text":"é"}\n', encoding="utf-8")
    (tmp_path / "manifest.jsonl").write_text('{"segment_id":"zz"}\n')
    got = readers.read_manifests(spark, str(tmp_path))
    assert sorted((r.src_file, r.segment_id) for r in got.collect()) == [("manifest.a.jsonl", "a0"), ("manifest.b.jsonl", "b0"), ("manifest.b.jsonl", "b1")]
    assert [r.segment_id for r in got.orderBy("ord").collect()] == ["a0", "b0", "b1"]  # by name, though b is larger
    (tmp_path / "order of").mkdir()
    for name, n in (("a", 2), ("b", 300), ("c", 5)):
        (tmp_path / "order of" / f"manifest.{name} x.jsonl").write_text("".join(f'{{"segment_id":"{name}{i}"}}\n' for i in range(n)))
    many = readers.read_manifests(spark, str(tmp_path / "order of")).orderBy("ord").collect()
    assert [r.segment_id for r in many] == [f"{n}{i}" for n, k in (("a", 2), ("b", 300), ("c", 5)) for i in range(k)]
    with pytest.raises(FileNotFoundError):
        readers.read_manifests(spark, str(tmp_path / "none"))
    writers.write_by_meeting(records(spark, ROWS), str(tmp_path / "by"))
    assert spark.read.json(str(tmp_path / "by")).count() == 5
    writers.write_manifest(records(spark, ROWS), str(tmp_path / "one"), single=True)
    part = next((tmp_path / "one").glob("part-*"))
    assert [json.loads(x)["segment_id"] for x in part.read_text(encoding="utf-8").splitlines()] == ["s0", "s1", "s2", "s3", "s4"]


def test_tables(spark, tmp_path):
    frame = spark.createDataFrame([("s0", "m", 'a "b"\nc', ""), ("s0", "m", "x", "y")], schemas.PREDICTION)
    writers.write_predictions(frame, str(tmp_path / "p"))
    back = readers.read_predictions(spark, str(tmp_path / "p"))
    assert sorted((r.ref, r.hyp) for r in back.collect()) == [('a "b"\nc', ""), ("x", "y")]
    assert readers.last_of_key(back, "meeting_id", "segment_id").count() == 1
    (tmp_path / "s.csv").write_text("lambda,val_cer,ood_cer\n0.0,0.1,\n0.5,0.05,0.02\n")
    assert [r.ood_cer for r in readers.read_sweep(spark, str(tmp_path / "s.csv")).orderBy("lambda").collect()] == [None, 0.02]
    assert readers.read_sweep(spark, str(tmp_path / "s.csv"), percent=True).where("lambda = 0.5").first().val_cer == 5.0
    (tmp_path / "t.csv").write_text("step,loss,learning_rate,eval_val_cer\n1,2.0,,\n2,,,0.5\n")
    path = str(tmp_path / "t.csv")
    assert [(r.step, r.learning_rate) for r in readers.read_training(spark, path).collect()] == [(1, 0.0)]
    whole = readers.read_csv(spark, path, "step long, loss double, learning_rate double, eval_val_cer double")
    assert sorted(tuple(r) for r in readers.training_series(whole, "loss", "eval_val_cer").collect()) == [("eval_val_cer", 2, 0.5), ("loss", 1, 2.0)]
    for n, v in (("9", 0.3), ("10", 0.2)):
        (tmp_path / f"run/checkpoint-{n}").mkdir(parents=True)
        (tmp_path / f"run/checkpoint-{n}/trainer_state.json").write_text(json.dumps({"log_history": [{"step": 1}, {"step": 2, "cer": v}]}))
    assert [tuple(r) for r in readers.read_trainer_state(spark, str(tmp_path / "run"), "cer").collect()] == [(2, 0.2)]
    with gzip.open(tmp_path / "prompts.gz", "wt", encoding="utf-8") as f:
        f.write("V1_1 XIN CHÀO\n\n")
    assert [tuple(r) for r in readers.read_prompts(spark, str(tmp_path / "prompts.gz")).collect()] == [("V1_1", "xin chào")]
    (tmp_path / "c.json").write_text('{"s1": "một",\n "s2": ""}', encoding="utf-8")
    assert sorted(tuple(r) for r in readers.read_corrections(spark, str(tmp_path / "c.json")).collect()) == [("s1", "một"), ("s2", "")]
    (tmp_path / "urls.txt").write_text(" https://a\n# no\nhttp://b \n")
    assert sorted(r.url for r in readers.read_urls(spark, str(tmp_path / "urls.txt")).collect()) == ["http://b", "https://a"]
    spark.createDataFrame([("Xin",), ("Chào",)], "sentence string").coalesce(1).write.parquet(str(tmp_path / "v"))
    assert [r.segment_id for r in readers.read_utterances(spark, str(tmp_path / "v"), "test", 1).collect()] == ["utt_test_00000"]
    assert sorted(r.segment_id for r in readers.read_utterances(spark, str(tmp_path / "v"), "test").collect()) == ["utt_test_00000", "utt_test_00001"]
    (tmp_path / "m1.json").write_text(json.dumps({"segments": [{"start": 0, "end": 1.5, "text": "a", "speaker": "x"}]}))
    assert [(r.meeting_id, r.end) for r in readers.read_draft_segments(spark, str(tmp_path / "m1.json")).collect()] == [("m1", 1.5)]


def test_checksums(spark, tmp_path):
    (tmp_path / "d/sub").mkdir(parents=True)
    for name in ("a.txt", "sub/b.txt", "c.txt"):
        (tmp_path / "d" / name).write_text(name)
    hashes = readers.file_hashes(spark, str(tmp_path / "d"))
    writers.write_checksums(hashes, str(tmp_path / "sums"))
    listed = readers.read_checksums(spark, str(tmp_path / "sums"))
    assert sorted(r.path for r in listed.collect()) == ["a.txt", "c.txt", "sub/b.txt"]
    assert checks.checksum_report(listed, hashes).count() == 0
    (tmp_path / "d/a.txt").write_text("other")
    (tmp_path / "d/c.txt").unlink()
    (tmp_path / "d/new.txt").write_text("new")
    got = checks.checksum_report(listed, readers.file_hashes(spark, str(tmp_path / "d")))
    assert sorted(tuple(r) for r in got.collect()) == [("a.txt", "MISMATCH"), ("c.txt", "MISSING")]
    assert "&lt;b&gt;" in writers.worksheet(records(spark, [("s", "m", "d", "s", 1.0, "<b>", None, 0)])).first().html


def test_streams(spark, tmp_path):
    from lectern.streaming import append_new, appended, bucket_counts, pause_sessions

    rows = spark.sql("select timestamp'2026-01-01 00:00:00' + make_interval(0,0,0,0,0,m) as ts, 'u' as user_id, cast(m as double) as value from values (0), (1), (6), (90) as t(m)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = bucket_counts(stream).writeStream.outputMode("complete").format("memory").queryName("buckets").start()
    query.processAllAvailable()
    query.stop()
    key = lambda f: sorted((str(r.start), r.n, r.total) for r in f.collect())
    assert key(spark.table("buckets")) == key(bucket_counts(rows)) and len(key(bucket_counts(rows))) == 3
    assert sorted(r.n for r in pause_sessions(rows, "user_id").collect()) == [1, 3]
    batch = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, sha string")
    for _ in range(2):
        append_new(batch, str(tmp_path / "out"), "id", "sha")
    assert appended(spark, str(tmp_path / "out"), batch.schema).count() == 2
    with pytest.raises(Exception, match="changed content"):
        append_new(batch.replace("1", "9"), str(tmp_path / "out"), "id", "sha")
