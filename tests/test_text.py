import random
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions.numbers_vi import convert, words_to_digits


def column(spark, texts, build):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in sorted(frame.select("i", build(F.col("t")).alias("v")).collect())]


@pytest.mark.parametrize(
    ("words", "digits"),
    [
        ("không chín tám bảy", "0987"),
        ("một trăm hai mươi ba", "123"),
        ("mười lăm", "15"),
        ("năm trăm", "500"),
        ("một trăm linh năm", "105"),
        ("hai mươi tư", "24"),
        ("hai ba nghìn", "23000"),
        ("hai triệu ba nghìn linh một", "2003001"),
    ],
)
def test_number_words(words, digits):
    assert convert(words) == (digits, 1)


def test_lone_words_are_no_numbers():
    assert convert("tôi không đi") == ("tôi không đi", 0)
    assert convert("anh linh nói") == ("anh linh nói", 0)
    assert convert("năm linh đi hai ba") == ("5 linh đi 23", 2)
    assert convert("") == ("", 0)


def test_number_udf_handles_null(spark):
    assert column(spark, ["mười lăm", None, ""], lambda c: words_to_digits(c)["text"]) == ["15", None, ""]


def test_normalize_order(spark):
    got = column(spark, ["Xin, CHÀO…  bạn!", "à ừm  ok-ay", None, "   "], lambda c: tx.normalize(c, filler_tokens=("Ừm",)))
    assert got == ["xin chào bạn", "à ok-ay", None, ""]
    with pytest.raises(ValueError):
        tx.normalize(F.lit("x"), filler_tokens=("Ạ",))
    with pytest.raises(ValueError):
        tx.Normalizer(number_convention="digits")


def test_compose_joins_marks(spark):
    assert column(spark, ["é", None], tx.nfc) == ["é", None]


def test_tokens_of_odd_spaces(spark):
    assert column(spark, ["", " a  b ", "a b\tc\n", None], tx.tokens) == [[], ["a", "b"], ["a", "b", "c"], None]


def test_fillers_keep_repeats(spark):
    assert column(spark, ["a b a c"], lambda c: tx.without(tx.tokens(c), ("b",))) == [["a", "a", "c"]]


def test_syllable_shape(spark):
    words = "không cũng được nhưng trước điều phương hoặc tuần report model dependency mapping rollback".split()
    assert column(spark, words, tx.is_vietnamese_shaped) == [True] * 9 + [False] * 5
    assert column(spark, ["được"], tx.strip_tone) == ["đươc"]


def test_tones_of_any_letter(spark):
    """All letters below U+2000 that hold one of the five marks, composed and decomposed, against the rule."""
    marks = {0x300, 0x301, 0x303, 0x309, 0x323}
    letters = [chr(i) for i in range(0xC0, 0x2000) if marks & set(map(ord, unicodedata.normalize("NFD", chr(i)))) and i not in (*marks, 0x340, 0x341)]
    assert len(letters) > 350
    bare = lambda t: unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", t) if ord(c) not in marks))
    assert column(spark, letters, tx.strip_tone) == [bare(c) for c in letters]
    vietnamese = [b + m for b in "aăâeêioôơuưyAĂÂEÊIOÔƠUƯY" for m in ("", *map(chr, marks))]
    whole = [unicodedata.normalize("NFD", f"ng{v}c") for v in vietnamese]
    assert column(spark, whole, tx.strip_tone) == [bare(w) for w in whole]
    words = ["doñ", "ñga", "tañ", "đường", unicodedata.normalize("NFD", "đường"), "ça", "\u1e39a"]
    assert column(spark, words, tx.is_vietnamese_shaped) == [True, True, True, True, True, False, False]


def test_normalizer_audit(spark):
    frame = spark.createDataFrame([(1, "Ừm, hai mươi ừm người"), (1, "e\u0301 không"), (2, None)], "k int, t string")
    one = tx.Normalizer(filler_tokens=("ỪM",))
    assert column(spark, ["Ừm, hai mươi ừm người", "e\u0301 không"], one) == ["20 người", "é không"]
    assert {r.k: (r.conversions, r.fillers_removed) for r in tx.audit(frame, one, "t", "k").collect()} == {1: (1, 2), 2: (None, None)}
    assert column(spark, ["hai mươi"], one.other()) == ["hai mươi"]
    odd = ["K\u212b", "\uf900", "\u1100\u1161\u11a8", "a\u0323\u0306", "plain", "\u0958"]
    assert column(spark, odd, tx.nfc) == [unicodedata.normalize("NFC", t) for t in odd]
    assert column(spark, ["\t[x]\n", "[x\n]", "\x1c[y]"], tx.is_label) == [True, False, True]


def test_small_scalars(spark):
    assert column(spark, ["seg_0000_3", "seg_0001", "other_9"], tx.parent_id) == ["seg_0000", "seg_0001", "other_9"]
    assert column(spark, ["seg_0000_3", "seg_0001", "seg_0002_10"], tx.chunk_number) == [3, 0, 10]
    assert column(spark, ["“hé”,", '"(Ok)..."'], tx.bare) == ["“hé”", "ok"]
    assert column(spark, ["a, b. c?"], tx.mark_count) == [3]
    assert column(spark, ["a1 22 b", "none"], tx.digit_groups) == [["1", "22"], []]
    assert column(spark, ["[Âm nhạc]", " [x] ", "a [x]", "[]"], tx.is_label) == [True, True, False, False]
    assert column(spark, ["A [x]  b"], tx.review_form) == ["a b"]
    assert column(spark, ["<a href='x'>&\""], tx.html_escape) == ["&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;"]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_edit_distances_match_a_table(spark):
    rng = random.Random(3)
    pairs = [(" ".join(rng.choices("họp hop a é 😀 bb".split(), k=rng.randrange(7))), " ".join(rng.choices("họp hop a é 😀 bb".split(), k=rng.randrange(7)))) for _ in range(150)]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, ref string, hyp string")
    rows = frame.select("i", tx.char_edits(F.col("ref"), F.col("hyp")), tx.word_edits(F.col("ref"), F.col("hyp"))).collect()
    for i, chars, words in rows:
        assert chars == edit_distance(*pairs[i])
        assert words == edit_distance(pairs[i][0].split(), pairs[i][1].split())


def test_word_edits_of_many_distinct_words(spark):
    n = 36_500  # more than there are code points below the surrogates
    words = [f"w{i}" for i in range(n)]
    rows = [(0, " ".join(words), "w35326 w35327 w35328 w36400 x"), (1, "a b", "a c"), (2, " ".join(words), f"w{n - 1}")]
    frame = spark.createDataFrame(rows, "i int, ref string, hyp string")
    got = {r.i: r.e for r in frame.select("i", tx.word_edits(F.col("ref"), F.col("hyp")).alias("e")).collect()}
    assert got == {0: n - 4, 1: 1, 2: n - 1}


def test_long_texts_that_are_alike_take_no_table(spark):
    """A table of 80,000 by 80,000 would take a minute and more; so would the words' one of the second pair."""
    text = "".join(f"w{i % 977} of the " for i in range(8000))
    rows = [(0, text, "zz" + text), (1, text, text.replace("of the ", "of te ")), (2, text + "é b", text + "a b c")]
    frame = spark.createDataFrame(rows, "i int, ref string, hyp string").repartition(3)
    began = time.monotonic()
    got = frame.select("i", tx.char_edits(F.col("ref"), F.col("hyp")), tx.word_edits(F.col("ref"), F.col("hyp"))).collect()
    assert {tuple(r) for r in got} == {(0, 2, 1), (1, 8000, 8000), (2, 3, 2)} and time.monotonic() - began < 30


def test_edit_distances_of_alike_texts_match_a_table(spark):
    rng = random.Random(7)
    units = ["a", "b", "é", "😀", " ", " ", "  ", "\t", "of the "]
    pairs = [("a b", "a x b"), ("a  b", "a b"), ("", "a"), (" ", ""), ("a b a b", "b a b a")]
    for _ in range(200):
        ref = rng.choices(units, k=rng.randrange(12))
        hyp = [rng.choice((u, u, u, u, rng.choice(units), "", "a" + u)) for u in ref]
        pairs += [("".join(ref), "".join(hyp)), ("".join(ref), "".join(ref).replace("of the ", "of te "))]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)] + [(-1, None, "a")], "i int, ref string, hyp string")
    for i, chars, words in frame.select("i", tx.char_edits(F.col("ref"), F.col("hyp")), tx.word_edits(F.col("ref"), F.col("hyp"))).collect():
        assert (chars, words) == ((None, None) if i < 0 else (edit_distance(*pairs[i]), edit_distance(pairs[i][0].split(), pairs[i][1].split())))
