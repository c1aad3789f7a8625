import json

import pytest
from pyspark.sql import functions as F

from lectern import config
from lectern.functions import text as tx
from lectern.operators import provider, reports, scoring
from lectern.operators.checks import IntegrityError
from lectern.sources import writers

YAML = """
run_id: r1
base_model: m
data: {dataset_path: d/train, ood_eval_path: d2, real_bench_path: null, val_meetings: [a]}
lora: {rank: 8, alpha: 16}
training: {learning_rate: 1.0e-4}
"""


def test_settings(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text(YAML)
    got = config.load(path, ("lora.rank=32", "data.val_meetings=[b, c]"))
    assert got["lora"]["rank"] == 32 and got["data"]["val_meetings"] == ["b", "c"] and got["sweep"]["ood_cer_budget"] == 0.02
    assert config.view(got).gates.min_improvement_pct == 10.0
    assert json.loads(config.freeze(got, tmp_path / "o/config.json").read_text()) == got
    for bad in ("lora.rank=0", "training.learning_rate=5e-05", "data.ood_eval_path=null", "data.real_bench_path=d", "data.real_bench_path=d/train/x", "nothing.at=1", "lora.other=1", "lora.rank"):
        with pytest.raises(config.SettingsError):
            config.load(path, (bad,))
    path.write_text(YAML + "hub: {push: true}\n")
    with pytest.raises(config.SettingsError, match="repo_id"):
        config.load(path)
    path.write_text(YAML + "normalization: {filler_tokens: [Ạ]}\n")
    with pytest.raises(config.SettingsError, match="particles"):
        config.load(path)
    path.write_text("run_id: x\n")
    with pytest.raises(config.SettingsError, match="missing"):
        config.load(path)
    assert config.record_stage(tmp_path / "s.json", "a", n=1) and set(config.record_stage(tmp_path / "s.json", "b")) == {"a", "b"}
    assert [config.yaml_float(x) for x in (5e-05, 0.5, 1e-7)] == ["5.0e-05", "0.5", "1.0e-07"]


def test_provider(spark):
    def load():
        return lambda batch: [x.upper() for x in batch]

    frame = spark.createDataFrame([(f"s{i}", f"a{i}", "A 1") for i in range(20)], "segment_id string, audio_filepath string, text string")
    got = provider.transcribe(frame, load, batch_size=3)
    assert sorted(r.hyp_raw for r in got.collect()) == sorted(f"A{i}" for i in range(20))
    rows = provider.scored(got, tx.normalize)
    assert rows.first().ref == "a 1" and rows.first().hyp.startswith("a")
    with pytest.raises(Exception, match="0 texts for"):
        provider.transcribe(frame, lambda: lambda batch: []).collect()
    heard = spark.createDataFrame([(0.5, "s1", "x")], "lambda double, segment_id string, hyp_raw string")
    grid = provider.sweep(frame, [0.0, 0.5], heard)
    assert grid.count() == 40 and grid.where("hyp_raw = 'x'").count() == 1


def test_provenance():
    settings = {"lora": {"alpha": 32, "rank": 16}, "base_model": "m"}
    gate, sweep = {"overall_pass": True, "tier2_ood": {"cer": 0.03}}, [{"lambda": 0.75, "ood_cer": 0.03}]
    adapter = {"lora_alpha": 24, "r": 16, "base_model": "m"}
    assert reports.check_provenance(settings, gate, sweep, adapter) == 0.75
    for other in ((gate | {"overall_pass": None}, sweep, adapter), (gate, [], adapter), (gate, [{"lambda": 0.75, "ood_cer": 0.04}], adapter), (gate, sweep, adapter | {"r": 8}), (gate, sweep, adapter | {"base_model": "n"})):
        with pytest.raises(IntegrityError):
            reports.check_provenance(settings, *other)


def test_rescoring_and_texts(spark, tmp_path):
    def chunks(hyps):
        return spark.createDataFrame([(f"seg_{i:04d}_0", "m", i, "abcd", h) for i, h in enumerate(hyps)], "segment_id string, meeting_id string, ord long, ref string, hyp string")

    row = reports.rescore_real(chunks(["abcd"] * 6), chunks(["abxx"] * 6), 0.1).first()
    assert (row.cer, row["pass"], row.verdict, row.delta_lo) == (0.0, True, "IMPROVED", 0.5)
    assert reports.rescore_real(chunks(["abcd"] * 6), chunks(["abxx"] * 5), 0.1).first().verdict == "SKIPPED"
    a = spark.createDataFrame([(1, "B."), (0, "A,")], "ord long, text string")
    b = spark.createDataFrame([(0, "a b")], "ord long, text string")
    assert reports.consensus_cer(a, b, tx.normalize).first().cer == 0.0
    card = reports.model_card("x", [{"tier": "t", "cer": 0.5, "bound": None, "pass": True}], [])
    assert "| t | 0.5000 | – | True |" in card
    report = reports.probe_report([{"ok": False, "rule": 2, "title": "v", "duration": 90.0}])
    assert "REJECT (rule 2)" in report and "1.5 min" in report
    assert "0 accepted, 1 rejected" in report and reports.probe_report([]) == ""
    full = {"ok": True, "rule": None, "reason": "accepted", "track": "vi", "title": None, "url": "u", "duration": 60.0, "n_words": 7, "digit_word_rate": 0.25, "first_wpm": 99.6, "last_wpm": 0.0, "labels": ["[a]"], "subtitles": {}}
    report = reports.probe_report([full, full | {"draft_error": "429", "n_words": None}], [("v", "gone")])
    for line in ("2 accepted, 1 rejected", "| v | – | error: gone |", "| words | 7 |", "| words with digits | 25.00% |", "first bucket | 100 |", "- owner's tracks: none", "- labels: [a]", "rule 3 and the measures are missing: 429"):
        assert line in report
    card = reports.model_card("x", [], [], {"base_model": "m", "run_id": "r", "lora": {"rank": 8, "alpha": 16}}, 0.75, "hand", False)
    assert "- weight: 0.75" in card and "- weight chosen by: hand" in card and "**FAIL**" in card and "targets" not in card
    reports.write_report(report, tmp_path / "r.md")
    with pytest.raises(IntegrityError):
        reports.write_report(" ", tmp_path / "r.md")
    path = tmp_path / "g.json"
    path.write_text("1")
    kept = reports.replace_json(path, {"a": "é"})
    reports.replace_json(path, 3)
    assert kept.read_text() == "1" and path.read_text() == "3"
    segments = spark.createDataFrame([("s1", "<b>"), ("s0", None)], "segment_id string, text string")
    page = reports.html_page(writers.worksheet(segments), "t")
    assert page.index('id="s0"') < page.index('id="s1"') and "&lt;b&gt;" in page


def test_tiny_strings(spark):
    assert scoring.counted(spark.createDataFrame([("", "")], "ref string, hyp string")).select(F.col("word_ref_len")).first()[0] == 0
