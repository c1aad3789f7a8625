import random

import numpy as np
import pytest

from lectern.functions import text as tx
from lectern.operators import distances, reports


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        own = [i]
        for j, y in enumerate(b, 1):
            own.append(min(row[j] + 1, own[-1] + 1, row[j - 1] + (x != y)))
        row = own
    return row[-1]


def texts(seed, n, longest, letters="abcđ😀 "):
    rng = random.Random(seed)
    make = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, longest)))
    return [(make(), make()) for _ in range(n)]


@pytest.mark.parametrize("stripe", [1, 3, 8, 64])
def test_tiles_equal_the_whole_table(monkeypatch, stripe):
    monkeypatch.setattr(distances, "STRIPE", stripe)
    for a, b in texts(stripe, 60, 40):
        for side in (4, 9, 100):
            right, lower, total = {}, {}, len(a)
            for i in range(0, len(a), side):
                for j in range(0, len(b), side):
                    right[i, j], lower[i, j] = distances.tile(a[i : i + side], b[j : j + side], right.get((i, j - side)), lower.get((i - side, j)))
            total += sum(int(np.frombuffer(h, dtype=np.int8).sum()) for (i, _), h in lower.items() if i + side >= len(a))
            assert total == plain(a, b)


def test_rounds_of_tiles_equal_the_built_in(spark):
    pairs = [*texts(5, 25, 90), ("", "abc"), ("abc", ""), ("", ""), (None, "a"), ("a", None), ("x" * 70, "x" * 70), *[("ab" * 40, "ba" * 30)] * 3]
    rows = spark.createDataFrame([(i % 7, a, b, 1) for i, (a, b) in enumerate(pairs)], "i int, ref string, hyp string, total int")
    tiled = distances.edits(rows, tile_side=16, short=50)
    assert tiled.columns == ["i", "ref", "hyp", "total", "char_edits"]
    wanted = rows.withColumn("char_edits", tx.char_edits(rows.ref, rows.hyp))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, tiled.collect()), key=key) == sorted(map(tuple, wanted.collect()), key=key)


def test_nothing_long_takes_no_round(spark):
    empty = spark.createDataFrame([], "ref string, hyp string")
    assert distances.edits(empty).collect() == []
    one = distances.edits(spark.createDataFrame([("kitten", "sitting")], "ref string, hyp string"))
    assert one.first().char_edits == 3


def test_a_hundred_thousand_characters_a_side(spark):
    rng = random.Random(3)
    ref = "".join(rng.choice("abcdefgh ") for _ in range(100_000))
    hyp = "".join(c for c in ref if rng.random() > 0.1)  # a subsequence: as far apart as their lengths
    rows = spark.createDataFrame([(ref, hyp), (hyp, ref)], "ref string, hyp string")
    assert {r.char_edits for r in distances.edits(rows, tile_side=1 << 15).select("char_edits").collect()} == {len(ref) - len(hyp)}


def test_consensus_by_recording(spark):
    a = spark.createDataFrame([("m", 2, "B"), ("m", 1, "A"), ("n", 1, ""), ("alone", 1, "x"), (None, 1, "ab")], "key string, ord int, text string")
    b = spark.createDataFrame([("m", 1, "a c"), ("n", 1, "x"), (None, 1, "ab")], "key string, ord int, text string")
    got = {r.key: r.cer for r in reports.consensus_cer(a, b, tx.Normalizer(), "key").collect()}
    assert got == {"m": 1 / 3, "n": None, None: 0.0}


def test_texts_with_omissions_only_take_no_tile(spark, monkeypatch):
    """One side without some of the other's characters is as far as their lengths, and told without a round."""

    def no_round(*_):
        raise AssertionError("a round")

    rng = random.Random(8)
    ref = "".join(rng.choice("abcđ😀 ") for _ in range(900))
    hyp = "".join(c for c in ref if c != "b")
    rows = spark.createDataFrame([(ref, hyp), (hyp, ref), (ref, ""), (None, ref)], "ref string, hyp string")
    with monkeypatch.context() as m:
        m.setattr(distances, "_fill", no_round)
        m.setattr(distances, "fresh_folder", no_round)
        assert [r.char_edits for r in distances.edits(rows, short=0).collect()] == [len(ref) - len(hyp), len(ref) - len(hyp), len(ref), None]
    for a, b in texts(9, 40, 12, "ab"):
        assert distances._subsequence(*sorted((a, b), key=len)) == (plain(a, b) == abs(len(a) - len(b)))
