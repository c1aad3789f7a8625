import random

import pytest

from lectern.llm import components, kernels, minhash_dedup, substring_dedup
from tests.llm import brute


def docs(spark, rows, more="lang string"):
    return spark.createDataFrame([(d, t, "en") for d, t in rows], f"doc_id long, text string, {more}")


def corpus(seed, n=120):
    """Texts with copies, edited copies, chains of edits, shared passages, odd spaces and short ones."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["é", "Ñandú", "日本"]
    text = lambda k: rng.choice([" ", "\n", "  ", "\t"]).join(rng.choices(words, k=k))
    passage = text(45)
    rows = []
    for d in range(n):
        kind = rng.randrange(8)
        if kind == 0 and rows:
            t = rng.choice(rows)[1]
        elif kind in (1, 2) and rows:
            w = (rng.choice(rows)[1] or "").split()
            for _ in range(1 + len(w) // 40):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(words).upper()
            t = " ".join(w)
        elif kind == 3:
            t = text(rng.randrange(30)) + " " + passage + "\n" + text(rng.randrange(30))
        elif kind == 4:
            t = rng.choice(["", " \n", "one", "one two three four", None, text(19), text(20)])
        else:
            t = text(rng.randrange(10, 120))
        rows.append((d * 3 - 30, t))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_against_brute_force(spark, seed):
    rows = corpus(seed)
    got = substring_dedup.substring_dedup(docs(spark, rows).repartition(5)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute.substring_dedup(rows)
    for r in got:  # the text holds just the kept words
        assert brute.sha(" ".join(brute.WORD.findall(r.text or ""))) == r.kept_sha256


def test_substring_dedup_over_small_flushes_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "FLUSH", 300)
    monkeypatch.setattr(substring_dedup, "LEAST_FREQUENT", 6)  # frequent anchors are salted
    monkeypatch.setattr(substring_dedup, "MOST_PLACES", 4)  # and so are those that a sample of places finds
    monkeypatch.setattr(substring_dedup, "SAMPLED", 2)
    rows = corpus(3)
    n, k = 6, 2
    got = substring_dedup.substring_dedup(docs(spark, rows), n, k).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute.substring_dedup(rows, n)


def test_substring_dedup_keeps_what_it_does_not_cut(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(1, f"a\n{passage}  b"), (2, f"c\t{passage}\n\nd "), (3, None), (4, "x")]
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(docs(spark, rows)).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "c\td "
    assert got[3].text is None and got[3].n_words == 0 and got[4].text == "x" and got[1].lang == "en"


def test_substring_dedup_edge_tables(spark):
    empty = substring_dedup.substring_dedup(docs(spark, []))
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "lang", "n_words", "n_removed", "kept_sha256"]
    t = " ".join(f"q{i}" for i in range(30))
    odd = spark.createDataFrame([(None, t, "a", 1), (5, t, "b", 2), (5, t, "b", 2), (6, t, None, None)], "doc_id long, text string, bucket string, n_words int")
    got = substring_dedup.substring_dedup(odd).collect()
    assert sorted((r.doc_id or -1, r.n_removed, r.bucket or "") for r in got) == [(-1, 0, "a"), (5, 0, "b"), (5, 0, "b"), (6, 30, "")]
    long = spark.createDataFrame([(1, "a " * 60000), (2, "b" * 300000)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(long).collect()}
    assert got == {1: 59999, 2: 0}  # only the first window starts nowhere earlier, and the second covers all its words but one


def test_substring_dedup_of_repeated_ids(spark):
    """A document is its id and text: cuts of one text never reach another row of the same id."""
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    got = {(r.doc_id, r.text): r for r in substring_dedup.substring_dedup(docs(spark, [(1, a), (5, a), (5, b), (5, b)])).collect()}
    assert {k: r.n_removed for k, r in got.items()} == {(1, a): 0, (5, ""): 30, (5, b): 0}
    hot = [(7, f"h{i} " + a) for i in range(40)]  # one id, many texts: one keeps the passage
    got = substring_dedup.substring_dedup(docs(spark, hot)).collect()
    assert sorted(r.n_removed for r in got) == [0] + [30] * 39


def test_lempel_ziv_factors(spark):
    """Every factor stands at its reference word for word, earlier, and no factor could go on."""
    rows = corpus(7)
    words = {d: brute.WORD.findall(t or "") for d, t in rows}
    n = 6
    got = sorted(map(tuple, substring_dedup.lempel_ziv_factors(docs(spark, rows), n, 2).collect()))
    assert len(got) > 50 and len({g[2] for g in got}) > 5
    covered = {}
    for doc, start, size, ref, ref_start in got:
        assert size >= n and (ref, ref_start) < (doc, start)
        assert words[doc][start : start + size] == words[ref][ref_start : ref_start + size]
        for i in range(start, start + size - n + 1):
            assert (doc, i) not in covered  # a window is in one factor
            covered[doc, i] = True
    for one, two in zip(got, got[1:]):
        if one[0] == two[0] and one[1] + one[2] - n + 1 == two[1]:  # joined where both go on alike
            assert (one[3], one[4] + one[2] - n + 1) != two[3:5]
    first = {}
    want = set()
    for d, w in sorted(words.items()):
        for i in range(len(w) - n + 1):
            if first.setdefault(tuple(w[i : i + n]), (d, i)) != (d, i):
                want.add((d, i))
    assert set(covered) == want


def test_greedy_parse_follows_the_reference():
    import numpy as np

    count = np.array([3, 2, 3])
    windows = np.array([1, 2, 3, 8, 9, 1, 2, 9], dtype=np.uint64)
    lead = np.array([0, 1, 2, 3, 4, 0, 1, 4])
    at, n, ref = substring_dedup.parsed(count, windows, lead)
    assert (at.tolist(), n.tolist(), ref.tolist()) == ([5, 7], [2, 1], [0, 4])


@pytest.mark.parametrize("seed", [4, 5])
def test_near_dedup_against_brute_force(spark, seed):
    rows = corpus(seed)
    got = minhash_dedup.minhash_dedup(docs(spark, rows).repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute.near_dedup(rows)


def test_near_dedup_of_a_large_loose_group(spark, monkeypatch):
    """Edited copies of one text, many of them too far from each other and from any leader."""
    monkeypatch.setattr(minhash_dedup, "TILE", (16, 32))
    rng = random.Random(6)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for d in range(150):
        w = list(rng.choice(rows)[1].split()) if rows and d % 3 == 0 else list(base)
        for i in rng.sample(range(100), rng.randrange(7)):
            w[i] = f"x{rng.randrange(10**6)}"
        rows.append((d, " ".join(w)))
    got = minhash_dedup.minhash_dedup(docs(spark, rows)).collect()
    want = brute.near_dedup(rows)
    assert len({c for _, c, _ in want.values()}) > 1
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want


def test_near_dedup_edge_tables(spark):
    assert minhash_dedup.minhash_dedup(docs(spark, [])).count() == 0
    odd = spark.createDataFrame([(None, "a b", 1), (7, "a b", 2), (7, "a b", 2), (9, "A  B", None), (11, None, 3), (12, " ", 3), (13, "", 3)], "doc_id long, text string, key int")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.minhash_dedup(odd).collect())
    assert got == [(-1, 0, None, True), (7, 1, 7, True), (7, 1, 7, True), (9, 1, 7, False), (11, 0, 11, True), (12, 0, 12, True), (13, 0, 13, True)]


def test_near_dedup_of_long_texts_and_clashing_names(spark):
    rng = random.Random(9)
    w = [f"w{rng.randrange(5000)}" for _ in range(60_000)]
    near = list(w)
    for i in range(0, len(near), 100):
        near[i] = "y"
    rows = [(4, " ".join(w), "a"), (2, " ".join(near), "b"), (9, "z" * 400_000, "c"), (8, "Z" * 400_000, "d")]
    frame = spark.createDataFrame([(i, t, k, False) for i, t, k in rows], "doc_id long, text string, component_id string, kept boolean")
    got = {r.doc_id: r for r in minhash_dedup.minhash_dedup(frame, prefix="_lx_").collect()}
    assert {d: (r._lx_component_id, r._lx_kept, r.component_id, r.kept) for d, r in got.items()} == {4: (2, False, "a", False), 2: (2, True, "b", False), 9: (8, False, "c", False), 8: (8, True, "d", False)}
    plain = minhash_dedup.minhash_dedup(frame)
    assert {r.doc_id: r.component_id for r in plain.collect()} == {4: 2, 2: 2, 9: 8, 8: 8} and plain.columns.count("kept") == 1


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(200, 199), (199, 200), (7, 7)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 120)}, 199: 199, 200: 199}


def test_grams_are_content_hashes():
    import numpy as np
    import pyarrow as pa

    hashes = np.arange(50, dtype=np.uint64)
    for n in (1, 2, 3, 5, 8, 20):
        assert len(kernels.grams(hashes, n)) == 51 - n
        again = kernels.grams(np.concatenate([hashes[:7], hashes]), n)
        assert (again[7:] == kernels.grams(hashes, n)).all() and len(set(kernels.grams(hashes, n).tolist())) == 51 - n
    texts = pa.array(["a b", None, "", "c"])
    (_, _, data, bounds), = kernels.slices(texts)
    words = kernels.split_words(data, bounds)
    assert words.counts.tolist() == [2, 0, 0, 1] and len(set(words.hashes().tolist())) == 3


def thue_morse(n, a="a", b="b"):
    """The Thue-Morse word over a and b and its complement: sums over them in powers of any odd base agree modulo 2^64."""
    x, y = a, b
    while len(x) < n:
        x, y = x + y, y + x
    return x, y


@pytest.mark.parametrize("letters", ["ab", "AB"])
@pytest.mark.parametrize("frame", [("", ""), ("pre", ""), ("", "fix"), ("é" * 7, "-" * 64)])
def test_words_with_equal_polynomials_are_apart(spark, letters, frame):
    one, two = (frame[0] + w + frame[1] for w in thue_morse(1024, *letters))
    rows = [(1, one), (2, two), (3, one.swapcase()), (4, f"{one} {two}")]
    got = minhash_dedup.minhash_dedup(docs(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute.near_dedup(rows)
    w = [f"w{i}" for i in range(30)]
    rows = [(1, " ".join([*w[:5], one, *w[5:]])), (2, " ".join([*w[:5], two, *w[5:]])), (3, " ".join([*w[:5], one.swapcase(), *w[5:]]))]
    got = substring_dedup.substring_dedup(docs(spark, rows)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute.substring_dedup(rows)


def test_pipeline_stages_keep_words_with_equal_polynomials(spark):
    import corpus_pipeline

    one, two = thue_morse(1024)
    w = [f"w{i}" for i in range(30)]
    table = docs(spark, [(1, one), (2, two), (3, " ".join([*w[:5], one, *w[5:]])), (4, " ".join([*w[:5], two, *w[5:]]))])
    kept = corpus_pipeline.drop_near_duplicates(spark, table, "")
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, 4}
    assert {r.doc_id: len(r.text.split()) for r in corpus_pipeline.cut_repeats(spark, table, "").collect()} == {1: 1, 2: 1, 3: 31, 4: 6}


def test_hash_lanes_are_independent():
    import numpy as np
    import pyarrow as pa

    texts = pa.array([" ".join([f"w{i}", f"W{i}x" * (i % 40), "é" * (i % 9), thue_morse(2 ** (i % 11))[i % 2]]) for i in range(4000)])
    lanes = [[], []]
    for _, _, data, bounds in kernels.slices(texts):
        words = kernels.split_words(data, bounds)
        tokens = words.tokens()
        assert [bytes(data[a:b]) for a, b in zip(words.start, words.end)] == tokens.tolist()
        for lane in (0, 1):
            lanes[lane].append(words.keyed(lane, tokens=tokens))
            assert (words.keyed(lane, lower=True) == words.keyed(lane, tokens=np.array([t.lower() for t in tokens], dtype=object))).all()
    a, b = (np.unique(np.concatenate(x), return_inverse=True) for x in lanes)
    distinct = {t for x in texts.to_pylist() for t in x.split()}
    assert len(a[0]) == len(b[0]) == len(distinct)  # no collision in either
    first = np.unique(a[1], return_index=True)[1]
    for one, two in [(np.concatenate(lanes[0])[first], np.concatenate(lanes[1])[first])]:
        for g in (1, 5, 20):
            x, y = kernels.grams(one, g), kernels.grams(two, g)
            bits = lambda v: np.unpackbits(v.view(np.uint8)).reshape(-1, 64).astype(float) - 0.5
            assert np.abs(bits(x).T @ bits(y) / len(x) * 4).max() < 6 / len(x) ** 0.5  # no bit of one lane follows one of the other
