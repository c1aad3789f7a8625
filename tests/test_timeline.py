import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import timeline
from lectern.sources import schemas


def words(spark, starts, text="w"):
    return spark.createDataFrame([("m", i, text, float(s), float(s) + 0.1) for i, s in enumerate(starts)], "meeting_id string, ord long, text string, start double, end double")


def cuts(spark, at, duration):
    frame = spark.createDataFrame([([float(x) for x in at], float(duration))], "at array<double>, duration double")
    return frame.select(timeline.greedy_cuts(F.col("at"), F.col("duration"))).first()[0]


def test_gaps(spark):
    assert [r["at"] for r in timeline.gap_candidates(words(spark, [0.0, 0.1, 5.0]), "meeting_id").collect()] == [(0.1 + 5.0) / 2]


def test_greedy_cuts(spark):
    assert cuts(spark, [1, 16, 20, 50], 60) == [16.0, 46.0]
    assert cuts(spark, [], 95) == [30.0, 60.0, 90.0]
    assert cuts(spark, [], 30) == []
    rng = random.Random(4)
    for _ in range(5):
        at, duration = sorted(rng.uniform(0, 300) for _ in range(rng.randrange(30))), rng.uniform(0, 400)
        want, last = [], 0.0
        for t in at:
            if t - last > 30:
                last += 30
                want.append(last)
            elif t - last >= 15:
                last = t
                want.append(t)
        while duration - last > 30:
            last += 30
            want.append(last)
        assert cuts(spark, at, duration) == pytest.approx(want)


def test_segments_lose_no_word(spark):
    frame = words(spark, range(40))
    lengths = spark.createDataFrame([("m", 40.0)], "meeting_id string, duration double")
    assigned = timeline.assign_segments(frame, timeline.cuts_of(frame, lengths, "meeting_id"), "meeting_id")
    rows = timeline.segments(assigned, "meeting_id").collect()
    assert all(r.end - r.start <= 30 for r in rows) and sum(len(r.text.split()) for r in rows) == 40
    frame = words(spark, [0, 1, 20, 21])
    lengths = spark.createDataFrame([("m", 25.0)], "meeting_id string, duration double")
    found = timeline.cuts_of(frame, lengths, "meeting_id")
    assert timeline.segments(timeline.assign_segments(frame, found, "meeting_id"), "meeting_id").count() == 2


def test_words_out_of_order(spark):
    """A word that starts before its predecessor stays with it; behind one at the duration nothing counts."""
    frame = words(spark, [0, 31, 5, 32, 60, 33])
    cut = spark.createDataFrame([("m", [30.0], 60.0)], "meeting_id string, cuts array<double>, duration double")
    got = timeline.assign_segments(frame, cut, "meeting_id").orderBy("ord").collect()
    assert [(r.start, r.seg_no) for r in got] == [(0.0, 0), (31.0, 1), (5.0, 1), (32.0, 1)]


def test_silence(spark):
    quiet = [0.0, 0.0, 0.0, 5.0, 0.0, 6.0, 7.0, 8.0, 9.0, 9.0, 9.0, 9.0, 9.0, 9.0, 9.0, 9.0, 9.0, 9.0, 9.0, 9.0]
    rows = [("a", i, x) for i, x in enumerate(quiet)] + [("b", i, x + 100) for i, x in enumerate(quiet)]
    frames = spark.createDataFrame(rows, "k string, i long, rms double")
    got = sorted(map(tuple, timeline.silence_midpoints(frames, "k", "i", "rms", 0.5, seconds=1.5).collect()))
    assert got == [("a", 0.5), ("b", 0.5)]  # each recording has its own level; the run of one frame is too short


def test_ends(spark):
    frame = spark.createDataFrame([("m", 0, 0.0, 1.0), ("m", 1, 0.5, 3.0), ("m", 2, 2.0, None), ("m", 3, 5.0, 4.0)], "meeting_id string, ord long, start double, display_end double")
    assert [r.end for r in timeline.infer_end(frame, "meeting_id").orderBy("ord").collect()] == [0.5, 2.0, 5.0, 5.0]


def test_caption_documents(spark):
    events = [(0, 2000, [("xin", None, None), ("\n", 100, None), (" \u00a0chào\t", 500, None)]), (None, 5, [("x", 0, None)]), (3000, None, [("bạn", 0, None)]), (4000, 10, None)]
    docs = spark.createDataFrame([("m", events)], f"meeting_id string, {schemas.JSON3}")
    got = timeline.parse(docs, "json3", "meeting_id").orderBy("ord").collect()
    assert [(r.text, r.start, r.end) for r in got] == [("xin", 0.0, 0.5), ("chào", 0.5, 2.0), ("bạn", 3.0, 3.0)]
    untimed = spark.createDataFrame([("m", [(0, 10, [("a", None, None)])])], docs.schema)
    with pytest.raises(Exception, match="no word-level timing"):
        timeline.parse(untimed, "json3", "meeting_id").collect()
    for empty in ([], [(None, 5, [("x", 0, None)])], [(0, 10, [(" \n", 0, None)])]):
        with pytest.raises(Exception, match="no caption words"):
            timeline.parse(spark.createDataFrame([("m", empty)], docs.schema), "json3", "meeting_id").collect()
    entries = [("a", 0.0, 0.9, "word", "s1"), ("\n", 0.5, 0.6, "word", None), ("b ", 0.5, 0.9, None, None)]
    docs = spark.createDataFrame([("m", entries)], f"meeting_id string, {schemas.SCRIBE}")
    got = timeline.parse(docs, "scribe", "meeting_id").orderBy("ord").collect()
    assert [(r.text, r.start, r.end, r.speaker) for r in got] == [("a", 0.0, 0.5, "s1"), ("b", 0.5, 0.9, None)]  # ends are clipped to the next start
    with pytest.raises(Exception, match="no words in"):
        timeline.parse(spark.createDataFrame([("m", [("x", 0.0, 1.0, "audio_event", None)])], docs.schema), "scribe", "meeting_id").collect()
    broken = spark.createDataFrame([("m", [("a", None, 0.5, "word", None)])], docs.schema)
    with pytest.raises(Exception, match="no timing"):
        timeline.parse(broken, "scribe", "meeting_id").collect()
    with pytest.raises(ValueError):
        timeline.parse(docs, "other", "meeting_id")


def test_buckets_and_collapse(spark):
    frame = words(spark, [i * 0.5 for i in range(500)] + [300 + i for i in range(250)])
    lengths = spark.createDataFrame([("m", 600.0)], "meeting_id string, duration double")
    got = timeline.wpm_buckets(frame, lengths, "meeting_id").orderBy("i")
    assert [r.wpm for r in got.collect()] == [100.0, 50.0]
    lengths = spark.createDataFrame([("m", 620.0)], lengths.schema)
    assert timeline.wpm_buckets(frame, lengths, "meeting_id").count() == 2

    def collapsed(rates):
        rows = spark.createDataFrame([("m", i, float(w)) for i, w in enumerate(rates)], "meeting_id string, i long, wpm double")
        return timeline.wpm_collapse(rows, "meeting_id").first().collapsed

    assert [collapsed(x) for x in ([845, 160], [845, 800], [0, 845, 160], [845], [0, 0])] == [True, False, True, False, False]


def test_middle_window(spark):
    lengths = spark.createDataFrame([("m", 4000.0)], "meeting_id string, duration double")
    got = timeline.middle_window(words(spark, [0, 1100, 2899, 2900]), lengths, "meeting_id").orderBy("ord").collect()
    assert [r.start for r in got] == [0.0, 1799.0]
    short = spark.createDataFrame([("m", 100.0)], lengths.schema)
    assert timeline.middle_window(words(spark, [0, 99]), short, "meeting_id").count() == 2


def test_islands_frames_and_split(spark):
    frame = spark.createDataFrame([("m", i, q) for i, q in enumerate([1, 1, 0, 1, 0, 1, 1, 1])], "k string, i long, q int")
    got = sorted((r["first"], r["last"], r.n) for r in timeline.islands(frame, "k", "i", F.col("q") == 1).collect())
    assert got == [(0, 1, 2), (3, 3, 1), (5, 7, 3)]
    samples = spark.createDataFrame([([3.0, 4.0, 0.0, 0.0],), ([1.0],)], "x array<double>")
    assert [r[0] for r in samples.select(timeline.rms(F.col("x"), 2, 1)).collect()] == [pytest.approx([12.5**0.5, 8**0.5, 0.0]), [1.0]]  # too few samples make one frame
    text = spark.createDataFrame([("a b c d e f g h i j", [1.0, 2.0, 1.0]), ("", [1.0, 1.0]), ("a b c d e", [1.0, 1.0])], "t string, d array<double>")
    got = [r[0] for r in text.select(timeline.proportional_split(F.col("t"), F.col("d"))).collect()]
    assert got == [["a b", "c d e f g h", "i j"], ["", ""], ["a b", "c d e"]]  # 2.5 and 7.5 go to the even side
