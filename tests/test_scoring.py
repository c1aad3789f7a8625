import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.operators import gate, scoring, stats


def pairs(spark, rows, meeting="m"):
    data = [(f"s{i}", meeting, i, r, h) for i, (r, h) in enumerate(rows)]
    return spark.createDataFrame(data, "segment_id string, meeting_id string, ord long, ref string, hyp string")


def test_rate_is_a_ratio_of_sums(spark):
    row = scoring.score_by(scoring.counted(pairs(spark, [("abc", "zzz"), ("x" * 300, "x" * 300)]))).first()
    assert row.cer == 3 / 303 and row.n_segments == 2


def test_score_by_meeting(spark):
    frame = pairs(spark, [("aaaa", "aaaa")], "real_0001").union(pairs(spark, [("bbbb", "zzzz")], "real_0002"))
    assert {r.meeting_id: r.cer for r in scoring.score_by(scoring.counted(frame), "meeting_id").collect()} == {"real_0001": 0.0, "real_0002": 1.0}


def test_rejoin_sorts_by_number_and_ignores_chunk_borders(spark):
    rows = [(f"seg_0000_{i}", "m", 10 - i, chr(97 + i), chr(97 + i)) for i in range(11)]
    frame = spark.createDataFrame(rows, "segment_id string, meeting_id string, ord long, ref string, hyp string")
    assert scoring.rejoin_chunks(frame).first().ref == "a b c d e f g h i j k"
    frame = spark.createDataFrame([("seg_0000_0", "m", 0, "one two", "one"), ("seg_0000_1", "m", 1, "three four", "two three four")], frame.schema)
    whole = scoring.rejoin_chunks(frame)
    assert whole.count() == 1 and scoring.score_by(scoring.counted(whole)).first().cer == 0


def test_retention_counts_repeats(spark):
    frame = pairs(spark, [("gửi report và report lại", "gửi report và tim lại")])
    tokens = scoring.retained_tokens(frame, ["ord"])
    row = scoring.retention_by(tokens).first()
    assert (row.n_candidates, row.n_retained, row.retention) == (2, 1, 0.5)
    assert [tuple(r) for r in scoring.missing_tokens(tokens).collect()] == [("report", 1)]
    lost = scoring.retained_tokens(pairs(spark, [("zeta report alpha", ""), ("gamma gamma", "")]), ["ord"])
    assert [r.token for r in scoring.missing_tokens(lost, top=9).collect()] == ["gamma", "zeta", "report", "alpha"]  # equals as they come
    assert scoring.retention_by(scoring.retained_tokens(pairs(spark, [("chao ban", "chao")]), ["ord"])).first().retention is None


def test_error_inspection(spark):
    counted = scoring.counted(pairs(spark, [("abc", "zzz"), ("x" * 100, "x" * 80)]))
    assert [r.segment_id for r in scoring.ranked_by_edits(counted).collect()] == ["s1", "s0"]
    assert scoring.top_segment_share(counted).first().share == 20 / 23
    none = scoring.counted(pairs(spark, [("a", "a")]))
    assert scoring.top_segment_share(none).first().share == 0.0
    digits = scoring.digit_mismatch(pairs(spark, [("a 4", "a 4"), ("b 4", "b 5"), ("c", "c")]))
    assert [(r.segment_id, r.mismatch) for r in digits.orderBy("ord").collect()] == [("s0", False), ("s1", True)]
    loans = scoring.loanword_dropped(pairs(spark, [("chúng ta cần xem report này", "chúng ta cần xem này"), ("report", "report")]))
    assert [(r.segment_id, r.dropped) for r in loans.orderBy("ord").collect()] == [("s0", True), ("s1", False)]


def test_unknown_meeting_is_an_error(spark):
    meetings = spark.createDataFrame([("m", "a", 0), ("m", "b", 1)], "meeting_id string, source string, ord long")
    assert scoring.with_source(pairs(spark, [("a", "a")]), meetings).first().source == "b"
    with pytest.raises(Exception, match="no source"):
        scoring.with_source(pairs(spark, [("a", "a")], "other"), meetings).collect()


def test_regression_check(spark):
    good, bad = scoring.counted(pairs(spark, [("abcd", "abcd")])), scoring.counted(pairs(spark, [("abcd", "abcx")]))
    assert scoring.regression_check(good, bad).first().no_regression
    assert scoring.regression_check(good, good).first().no_regression
    assert not scoring.regression_check(bad, good).first().no_regression
    with pytest.raises(Exception, match="references differ"):
        scoring.regression_check(good, scoring.counted(pairs(spark, [("zzzz", "zzzz")]))).collect()
    with pytest.raises(Exception, match="no shared"):
        scoring.regression_check(good, scoring.counted(pairs(spark, [("abcd", "abcd")], "n"))).collect()


def counts(spark, edits, lengths):
    return spark.createDataFrame([(i, e, n) for i, (e, n) in enumerate(zip(edits, lengths, strict=True))], "ord long, char_edits long, char_ref_len long")


def test_bootstrap_matches_a_plain_model(spark):
    rng = random.Random(1)
    edits, lengths = [rng.randrange(6) for _ in range(40)], [rng.randrange(5, 15) for _ in range(40)]
    draw = random.Random(42)
    values = []
    for _ in range(1000):
        ids = [draw.randrange(40) for _ in range(40)]
        values.append(sum(edits[i] for i in ids) / sum(lengths[i] for i in ids))
    values.sort()
    row = stats.bootstrap_ci(counts(spark, edits, lengths)).first()
    assert math.isclose(row.lo, values[25]) and math.isclose(row.hi, values[975])


def test_methods_agree_at_any_size(spark):
    """The caller chooses the method; a row more changes neither it nor much of the interval."""
    rng = random.Random(2)
    edits = [rng.randrange(3) for _ in range(1001)]
    for n in (300, 1000, 1001):
        frame = counts(spark, edits[:n], [10] * n)
        exact, fast = stats.bootstrap_ci(frame).first(), stats.bootstrap_ci(frame, method="poisson").first()
        assert (exact["method"], fast["method"]) == ("exact", "poisson")
        assert abs(fast.lo - exact.lo) < 0.005 and abs(fast.hi - exact.hi) < 0.005
    with pytest.raises(ValueError):
        stats.bootstrap_ci(frame, method="other")


def test_paired_verdicts(spark):
    base, better = counts(spark, [5] * 30, [10] * 30), counts(spark, [1] * 30, [10] * 30)
    for a, b, want in ((base, better, "IMPROVED"), (better, base, "REGRESSED"), (base, base, "INCONCLUSIVE")):
        d = stats.bootstrap_delta_ci(scoring.paired(a, b))
        assert d.select(stats.verdict(F.col("lo"), F.col("hi"))).first()[0] == want
        keyed = stats.bootstrap_delta_ci(scoring.paired(a.withColumn("s", F.lit(1)), b.withColumn("s", F.lit(1)), "s", by="ord"), "s").first()
        assert (keyed.lo, keyed.hi) == tuple(d.first())[:2]
    less = counts(spark, [1] * 29, [10] * 29)
    assert scoring.paired(base, less).count() == scoring.paired(base, less, by="ord").count() == 0
    moved = better.withColumn("ord", F.col("ord") + 1)  # as many rows, but other keys
    assert scoring.paired(base, moved, by="ord").count() == 0 and scoring.paired(base, better.union(better), by="ord").count() == 0


SWEEP_4 = [(0.0, 0.10337330648114244, 0.022832927484899276), (0.25, 0.054833394361039914, 0.022611555611776985), (0.5, 0.036364884657634565, 0.026185130135036844), (0.75, 0.03316093006224826, 0.033427152841466114), (1.0, 0.03256590992310509, 0.04256664874608646)]
SWEEP_3 = [(0.0, 0.05829596412556054, 0.022832927484899276), (0.25, 0.025579485883913344, 0.023402169444356597), (0.5, 0.01597928377439525, 0.024888523449606275), (0.75, 0.01200025263689762, 0.0326365390088865), (1.0, 0.010231794353565337, 0.041428164827171814)]


def sweep(rows):
    return [dict(zip(("lambda", "val_cer", "ood_cer"), r, strict=True)) for r in rows]


def test_sweep_selection():
    base = SWEEP_4[0][2]
    assert stats.select_lambda(sweep(SWEEP_4), base, 0.02, 10) == 0.5
    assert stats.select_lambda(sweep(SWEEP_3), base, 0.02, 10) == 0.5
    assert stats.select_lambda(sweep(SWEEP_3), base, 0.02, 20) == 1.0
    assert stats.select_lambda(sweep(SWEEP_3), base, 0.0002, 10) == 0.0
    assert stats.select_lambda([*sweep(SWEEP_3), {"lambda": 0.1, "val_cer": 0.0, "ood_cer": None}], base, 0.02, 10) == 0.5
    with pytest.raises(ValueError):
        stats.select_lambda(sweep(SWEEP_3), 0.0, 0.001, 10)


def test_slice_gate_and_tiers(spark):
    def frame(rows):
        return scoring.counted(spark.createDataFrame(rows, "source string, ord long, ref string, hyp string"))

    candidate = frame([("syn", 0, "aaaa", "aaab"), ("yt", 1, "b" * 100, "b" * 100)])
    base = frame([("syn", 0, "aaaa", "aaaa"), ("yt", 1, "b" * 100, "c" * 100)])
    rows = {r.source: r for r in gate.slice_gate(candidate, base, "source", 10).collect()}
    assert rows["yt"]["pass"] and not rows["syn"]["pass"] and rows["yt"].verdict == "IMPROVED"
    two = frame([("syn", 0, "aaaa", "aaaa"), ("syn", 1, "aaaa", "aaaa")])
    row = gate.slice_gate(two, base, "source", 10).first()
    assert row.verdict == "SKIPPED" and row.baseline_cer == 0.0 and row.delta_lo is None
    tokens = scoring.retained_tokens(spark.createDataFrame([("syn", 0, "chao team build", "chao tim build")], "source string, ord long, ref string, hyp string"), ["source", "ord"])
    exact = scoring.retained_tokens(spark.createDataFrame([("syn", 0, "chao team build", "chao team build")], "source string, ord long, ref string, hyp string"), ["source", "ord"])
    row = gate.slice_gate(candidate, base, "source", 10, 0.05, tokens, exact).where("source = 'syn'").first()
    assert row.retention == 0.5 and row.baseline_retention == 1.0 and row.retention_pass is False
    result = {r.tier: r["pass"] for r in gate.run_gate(candidate, base, None, {"cer_test": 0.5, "cer_ood": 1.0}, 10, 0.02, 0.03).collect()}
    assert result == {"tier1_in_domain": True, "tier2_ood": True, "tier4a_real": None, "overall": True}
    chunks = spark.createDataFrame([("seg_0000_0", "m", 0, "one two", "one"), ("seg_0000_1", "m", 1, "three", "two three")], "segment_id string, meeting_id string, ord long, ref string, hyp string")
    slices = gate.slice_gate(candidate, base, "source", 10)
    result = {r.tier: r["pass"] for r in gate.run_gate(candidate, base, chunks, {"cer_test": 0.5, "cer_ood": 1.0, "cer_real": 0.0}, 10, 0.02, 0.03, slices).collect()}
    assert result == {"tier1_in_domain": False, "tier2_ood": True, "tier4a_real": True, "overall": False}


def test_curves(spark):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate([9.0, 5.0, 4.0, 6.0, 7.0, 3.0, 8.0, 8.0, 8.0])], "step long, v double")
    assert stats.early_stop(frame, "step", "v", 2).first().stopped_at == 4
    assert stats.early_stop(frame, "step", "v", 4).first().stopped_at is None
    assert stats.early_stop(frame, "step", "v", 3, greater_is_better=True).first().stopped_at == 3
    means = sorted((r.last, r["mean"]) for r in stats.block_means(frame, "step", "v", 4).collect())
    assert means == [(3, 6.0), (7, 6.5), (8, 8.0)]
    row = stats.curve_summary(frame, "step", "v", warmup_end=F.lit(0)).first()
    assert (row.steps, row["first"], row.least, row.diverged) == (9, 5.0, 3.0, True)  # steps are those of the whole log
    assert stats.curve_summary(frame, "step", "v", warmup_end=F.lit(99)).first().steps == 9


def test_convention_gap(spark):
    frame = pairs(spark, [("a b", "a  b")])
    row = scoring.convention_gap(frame, F.col("ref"), F.col("hyp"), F.col("ref"), F.replace(F.col("hyp"), F.lit("  "), F.lit(" "))).first()
    assert row.cer_b == 0 and row.delta_pp == 33.333
    assert scoring.length_ratio(frame).first().length_ratio == 1.333


def test_draws_are_pythons():
    for k in (1, 2, 7, 64, 1000, 70_000):
        rng = random.Random(9)
        want = [np.bincount([rng.randrange(k) for _ in range(k)], minlength=k) for _ in range(4)]
        assert all((a == b).all() for a, b in zip(want, stats.draws(k, 4, 9)))
        first = stats.Draws(k, 9)
        first.skip()
        assert (stats.Draws(k, 9, first.state()).counts(np.uint8) == want[1]).all()
    with pytest.raises(ValueError):
        stats.Draws(0)


def test_slices_in_blocks_equal_slices_in_groups(spark, monkeypatch):
    """Slices of one size, of no key, of a null key, at and above the range."""
    rng = random.Random(4)
    rows = [(name, (3 * i) % n, rng.randrange(9), rng.randrange(1, 20)) for name, n in [("a", 10), ("b", 64), ("c", 65), ("d", 500), ("e", 500), (None, 301), ("f", 1)] for i in range(n)]
    frame = spark.createDataFrame(rows, "source string, ord long, char_edits long, char_ref_len long").repartition(5)
    results = []
    for most in (1 << 14, 64, 16):
        monkeypatch.setattr(stats, "RANGE", most)
        monkeypatch.setattr(stats, "CHUNK", 100)
        one = stats.bootstrap_ci(frame, "source", resamples=60).collect()
        whole = stats.bootstrap_ci(frame.withColumn("ord", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_first(), "ord"))), resamples=30).collect()
        results.append((sorted(map(repr, one)), whole))
    assert results[0] == results[1] == results[2] and len(results[0][0]) == 7


def test_a_slice_of_a_million_rows(spark):
    n, resamples = 1_000_000, 3
    rng = random.Random(42)
    drawn = [np.bincount([rng.randrange(n) for _ in range(n)], minlength=n) for _ in range(resamples)]
    edits, lengths = np.arange(n) % 7, np.arange(n) % 13 + 1
    rates = sorted(float((w @ edits) / (w @ lengths)) for w in drawn)
    frame = spark.range(n).select(F.lit("s").alias("source"), (F.lit(2) * F.col("id")).alias("ord"), (F.col("id") % 7).alias("char_edits"), (F.col("id") % 13 + 1).alias("char_ref_len"))
    row = stats.bootstrap_ci(frame.orderBy(F.xxhash64("ord")), "source", resamples=resamples).first()
    assert (row.lo, row.hi) == (rates[0], rates[2])


def test_selected_lambdas_of_a_table_of_sweeps(spark):
    rng = random.Random(3)
    runs = {f"r{i}": [{"lambda": j / 8, "val_cer": rng.choice([0.1, 0.09, 0.05, 0.01]), "ood_cer": rng.choice([None, 0.0, 0.02, 0.03, 0.05, 0.2])} for j in range(rng.randrange(1, 9))] for i in range(60)}
    runs["none"] = [{"lambda": 0.0, "val_cer": 0.1, "ood_cer": 0.9}]
    frame = spark.createDataFrame([(k, *r.values()) for k, rows in runs.items() for r in rows], "run string, lambda double, val_cer double, ood_cer double").repartition(4)

    def chosen(rows):
        try:
            return stats.select_lambda(rows, 0.02, 0.1, 2)
        except ValueError:
            return None

    got = stats.selected_lambdas(frame, "run", baseline_ood=0.02, budget=0.1, threshold=2, strict=False)
    assert {r.run: r["lambda"] for r in got.collect()} == {k: chosen(rows) for k, rows in runs.items()}
    one = frame.where("run = 'r1'").withColumn("base", F.lit(0.02))
    assert stats.selected_lambdas(one, baseline_ood=F.col("base"), budget=0.1, threshold=2, strict=False).first()[0] == chosen(runs["r1"])
    with pytest.raises(Exception, match="no row keeps within the budget"):
        stats.selected_lambdas(frame.where("run = 'none'"), "run", baseline_ood=0.02, budget=0.1, threshold=2).collect()


def test_pairs_of_long_slices_meet_by_place(spark, monkeypatch):
    rows = [(s, (7 * i) % n, i % 5, i % 3 + 1) for s, n in [("a", 200), ("b", 30), (None, 90)] for i in range(n)]
    frame = spark.createDataFrame(rows, "source string, ord long, char_edits long, char_ref_len long").repartition(5)
    other = frame.withColumn("ord", F.col("ord") * 2 + 1).where("source is null or source = 'a' or ord <> 5")  # b has another number of rows
    want = sorted(map(repr, scoring.paired(frame, other, "source").where("source is not null").collect()))
    monkeypatch.setattr(scoring, "WHOLE", 20)
    got = scoring.paired(frame, other, "source").collect()
    assert sorted(repr(r) for r in got if r.source is not None) == want and len(want) == 200
    assert sum(r.source is None for r in got) == 90


def test_one_round_of_draws_gives_each_sides_own_intervals(spark):
    """Tied places, a slice that the base lacks, and one with other segments."""
    sizes = {"a": (7, 7), "b": (4, 0), "c": (5, 3)}
    side = lambda i: spark.createDataFrame([(s, k // 2, (k * 3 + i) % 5, 10 + k, (k + i) % 3, 2) for s, n in sizes.items() for k in range(n[i])], "source string, ord long, char_edits long, char_ref_len long, word_edits long, word_ref_len long")
    candidate, base = side(0), side(1)
    got = {r.source: r for r in gate.slice_gate(candidate, base, "source", 10, resamples=50).collect()}
    for frame, name in ((candidate, "ci"), (base, "baseline_ci")):
        own = {r.source: (r.lo, r.hi) for r in stats.bootstrap_ci(frame, "source", resamples=50).collect()}
        assert {s: (r[f"{name}_lo"], r[f"{name}_hi"]) for s, r in got.items()} == {s: own.get(s, (None, None)) for s in sizes}
    deltas = {r.source: (r.lo, r.hi) for r in stats.bootstrap_delta_ci(scoring.paired(base, candidate, "source"), "source", resamples=50).collect()}
    assert {s: (r.delta_lo, r.delta_hi) for s, r in got.items() if r.verdict != "SKIPPED"} == deltas
    assert {s for s, r in got.items() if r.verdict == "SKIPPED"} == {"b", "c"}
