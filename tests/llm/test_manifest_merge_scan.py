import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import adaptive_scan, branch_merge, merkle
from tests.llm.brute import sha

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def fold(nodes):
    """(root, proof of each node as text, each node's replaced root) of (node, claimed) pairs."""
    level = [(h, [i]) for i, (h, _) in enumerate(nodes)]
    proof, other = [""] * len(nodes), [c for _, c in nodes]
    while len(level) > 1:
        above = []
        for at in range(0, len(level), 3):
            run = level[at : at + 3]
            for i, (_, members) in enumerate(run):
                for m in members:
                    proof[m] += "".join(h for j, (h, _) in enumerate(run) if j != i)
                    other[m] = sha("".join(other[m] if j == i else h for j, (h, _) in enumerate(run)))
            above.append((sha("".join(h for h, _ in run)), [m for _, members in run for m in members]))
        level = above
    return level[0][0] if level else None, proof, other


def manifest_by_hand(rows, claimed):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs, below = [], {}
    for s in order:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        below[s] = (own, fold([(leaf(r), leaf(claimed(r))) for r in own]))
        subs.append(below[s][1][0])
    root, top, _ = fold([(h, h) for h in subs])
    out = []
    for k, s in enumerate(order):
        own, (sub, proof, other) = below[s]
        for r, p, o in zip(own, proof, other):
            replaced = fold([(h, o if j == k else h) for j, h in enumerate(subs)])[2][k]
            out.append((r[0], leaf(r), sub, root, sha(p + top[k]), replaced, replaced == root))
    return sorted(map(repr, out))


def documents(seed, n, sources):
    rng = random.Random(seed)
    rows = [(i, rng.choice(sources), rng.choice(["en", None, ""]), rng.choice([None, 5, -1]), rng.choice([None, "", "é\n日本", f"text {i}\nline\n", "a\r\n\n"])) for i in range(n)]
    return rows + rows[:2] + [(None, "s", "en", 1, "x\n"), (None, None, None, None, None), (7, "s", "other", 1, "same id\n")]


@pytest.mark.parametrize(("n", "sources"), [(40, ["s", "", None, "ä", "z"]), (1500, ["s"] * 9 + ["t"]), (12, [f"g{i}" for i in range(12)])])
def test_manifest_against_plain_version(spark, n, sources):
    rows = documents(n, n, sources)
    claimed = lambda r: (*r[:4], r[4].replace("\n", "")) if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r
    docs = spark.createDataFrame(rows, DOCS).repartition(5).withColumn("leaf", F.lit("own")).withColumn("tree", F.lit(3))
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    text = F.when(tampered, F.expr("replace(text, '\n', '')")).otherwise(F.col("text"))
    found = merkle.manifest(merkle.leaf_rows(docs, claimed={"text": text}))
    got = [(r.id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in merkle.proved(found).collect()]
    assert sorted(map(repr, got)) == manifest_by_hand(rows, claimed)
    # every parent is the digest of its preimage, and a slot of the parent above
    parents = {(r.tree, r.level, r.node): r.preimage for r in merkle.parents(found).collect()}
    for (tree, level, node), preimage in parents.items():
        if (above := parents.get((tree, level + 1, node // 3))) is not None:
            assert above[64 * (node % 3) : 64 * (node % 3 + 1)] == sha(preimage)
    for r in found.leaves.collect():
        if r.path:
            assert parents.get((r.tree, 1, r.place // 3), r.path[0].preimage) == r.path[0].preimage and r.leaf in r.path[0].preimage


def test_manifest_of_few_rows(spark):
    empty = merkle.proved(merkle.manifest(merkle.leaf_rows(spark.createDataFrame([], DOCS))))
    assert empty.count() == 0
    one = [(1, None, "en", 3, "abc")]
    (row,) = merkle.proved(merkle.manifest(merkle.leaf_rows(spark.createDataFrame(one, DOCS)))).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root == leaf(one[0]) and row.proof_sha256 == sha("") and row.verified


# --- three-way merge


def code(branch, doc_id, unit):
    return zlib.crc32(f"{branch}:{doc_id}:{unit}".encode()) % 7


def merged_by_hand(rows):
    """rows: doc_id -> (lang, source, text); the contract, one document at a time."""
    out = {}
    for d, (lang, source, text) in rows.items():
        base = {"lang": lang or "", "source": source or ""} | dict(enumerate((text or "").split("\n")))
        states, gaps, dropped = [], [], []
        for b in "LR":
            dropped.append(code(b, d, "row") == 0)
            state, gap = dict(base), {}
            for unit, value in base.items():
                c = code(b, d, unit)
                if c == 0:
                    state[unit] = "" if isinstance(unit, str) else None
                elif c in (1, 2):
                    state[unit] = value + "!?"[c - 1]
                elif c in (3, 4) and not isinstance(unit, str):
                    gap[unit] = "!?"[c - 3]
            states.append(state)
            gaps.append(gap)
        changed = [s != base or bool(g) for s, g in zip(states, gaps)]
        clean = ee = ed = ii = 0
        final, between = dict(base), {}
        for unit in base:
            x, y = (s[unit] for s in states)
            if x != base[unit] and y != base[unit] and x != y:
                ed, ee = (ed + 1, ee) if x is None or y is None else (ed, ee + 1)
            elif x != base[unit] or y != base[unit]:
                clean += 1
            final[unit] = y if y != base[unit] else x
            if unit in gaps[0] or unit in gaps[1]:
                if unit in gaps[0] and unit in gaps[1] and gaps[0][unit] != gaps[1][unit]:
                    ii += 1
                else:
                    clean += 1
                between[unit] = gaps[1].get(unit, gaps[0].get(unit))
        here = True
        if any(dropped):
            clean = ee = ed = ii = 0
            if all(dropped):
                clean, here = 1, False
            elif dropped[0]:
                clean, ed, here = int(not changed[1]), int(changed[1]), changed[1]
                final, between = states[1], gaps[1]
            else:
                clean, ed, here = int(not changed[0]), int(changed[0]), False
        lines = [t for i in range(len(base) - 2) for t in (final[i], between.get(i)) if t is not None]
        out[d] = (final["lang"], final["source"], "\n".join(lines), clean, ee, ed, ii) if here else (None, None, None, clean, ee, ed, ii)
        adds = [{3: "!", 4: "?"}.get(code(b, d, "row")) for b in "LR"]
        if any(adds):
            clash = all(adds) and adds[0] != adds[1]
            out[-1 - d] = (base["lang"], base["source"], adds[1] or adds[0], int(not clash), 0, 0, int(clash))
    return out


def test_merge_of_coded_branches_against_plain_version(spark):
    rng = random.Random(5)
    texts = [None, "", "\n", "one", "a\nb\nc", "é\n\n\nü"]
    rows = {d: (rng.choice([None, "", "en"]), rng.choice([None, "s"]), rng.choice(texts) if d % 3 else "\n".join(rng.choices(["x", "", "long line " * 9], k=rng.randrange(1, 40)))) for d in range(400)}
    rows[401] = ("en", "s", "\n".join(map(str, range(30000))))
    table = spark.createDataFrame([(d, *v, "clash") for d, v in rows.items()], "doc_id long, lang string, source string, text string, kind string").repartition(6)
    base = branch_merge.base_rows(table)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # ids are cut by batches
    try:
        found = branch_merge.merge(base, branch_merge.coded_branch(base, "L"), branch_merge.coded_branch(base, "R"), partitions=3).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len({r.doc_id for r in found})
    assert {r.doc_id: tuple(r)[1:] for r in found} == merged_by_hand(rows)


def branch(spark, rows, columns=("lang", "source")):
    return spark.createDataFrame([(d, kind, on, *values, text, edits) for d, kind, on, values, text, edits in rows], branch_merge.branch_schema(columns))


def test_merge_of_any_branches(spark):
    table = spark.createDataFrame([(1, "en", "a", "x\ny\nz"), (1, "en", "a", "x\ny\nz"), (2, "de", "b", "q"), (3, "de", "b", "q"), (None, "de", "b", "q")], "doc_id long, lang string, source string, text string")
    base = branch_merge.base_rows(table).withColumn("made_on", F.lit(0))
    none = (None, None)
    left = branch(spark, [
        (1, "change", 0, ("fr", "a"), None, [(0, False, None), (1, False, "y"), (2, True, "new"), (99, False, "none")]),  # `a`, `y` and line 99 are no changes
        (2, "drop", 0, none, None, None), (3, "change", 0, none, None, [(0, False, "q")]), (9, "drop", 0, none, None, None),
        (2, "add", 0, ("en", "c"), "twice", None), (5, "add", 0, ("en", "c"), "added", None), (6, "add", 0, ("en", "c"), "one", None)])
    right = branch(spark, [
        (1, "change", 0, ("it", None), None, [(0, False, "X"), (2, True, "new"), (1, True, "mid")]),
        (2, "change", 0, (None, "bb"), None, None), (3, "drop", None, none, None, None), (6, "add", 0, ("en", "d"), "one", None), (None, "add", 0, ("en", "d"), "one", None)])
    found = {r.doc_id: tuple(r)[1:] for r in branch_merge.merge(base, left, right).collect()}
    assert found == {
        1: ("it", "a", "X\ny\nmid\nz\nnew", 2, 1, 1, 0),
        2: ("de", "bb", "q", 0, 0, 1, 0),  # dropped by one, changed by the other, whose state stays
        3: (None, None, None, 1, 0, 0, 0),  # the left change is none
        5: ("en", "c", "added", 1, 0, 0, 0),
        6: ("en", "d", "one", 0, 0, 0, 1),
    }
    assert branch_merge.merge(base.limit(0), left.limit(0), right.limit(0)).count() == 0


def test_merge_takes_changes_made_on_the_row_that_stands(spark):
    """Rows of one id with other texts: the one with the least hash stands, with the changes and additions made on it."""
    rows = [(d, "en", "s", f"{t}\n" * (t + 1)) for d in range(60) for t in range(3)]
    table = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    base = branch_merge.base_rows(table)
    found = {r.doc_id: tuple(r)[1:] for r in branch_merge.merge(base, branch_merge.coded_branch(base, "L"), branch_merge.coded_branch(base, "R")).collect()}
    stands = {r.doc_id: (r.m.lang, r.m.source, r.m.text) for r in base.groupBy("doc_id").agg(F.min_by(F.struct("lang", "source", "text"), "made_on").alias("m")).collect()}
    assert found == merged_by_hand(stands)


# --- approximate nearest neighbours


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(4)


def nearest_by_hand(rows, every, k):
    good = {}
    width = max((len(v) for _, v in rows if v), default=1)
    for i, v in rows:
        if i is not None and v and any(v) and all(x is not None and math.isfinite(x) for x in v):
            good[i] = np.array(list(v) + [0.0] * (width - len(v)))
    ids = np.array(sorted(good))
    table = np.stack([good[i] for i in ids]) if len(ids) else np.zeros((0, width))
    out = {}
    for i in ids:
        if i % every == 0:
            d = np.sqrt(((table - good[i]) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            if order:
                out[int(i)] = [(int(ids[j]), d[j]) for j in order]
    return out


def by_query(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def sample_rows(seed, n, width=24):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, width)) * 3
    rows = [(i, list(centres[rng.integers(12)] + rng.standard_normal(width))) for i in range(n)]
    for i in range(0, n, 3):  # a third are one vector
        rows[i] = (i, rows[0][1])
    odd = [None, [], [0.0] * width, [1.0, None], [math.nan] * width, [math.inf] + [1.0] * (width - 1), [1.0, 2.0]]
    return rows + [(n + 7 * j, v) for j, v in enumerate(odd)] + [(None, rows[1][1])]


def test_full_scan_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(adaptive_scan, "WIDTH", 5)
    rows = sample_rows(1, 900)
    got = by_query(adaptive_scan.nearest(vectors(spark, rows), every=7, k=6, target=1.0, slack=math.inf, block_rows=60, query_rows=20))
    assert got == nearest_by_hand(rows, 7, 6)


@pytest.mark.parametrize("sample", [1 << 15, 200])
def test_recall_and_exact_scores(spark, monkeypatch, sample):
    monkeypatch.setattr(adaptive_scan, "SAMPLE_ROWS", sample)
    monkeypatch.setattr(adaptive_scan, "BOUND_ROWS", 100)
    rows = sample_rows(2, 3000)
    want = nearest_by_hand(rows, 10, 10)
    got = by_query(adaptive_scan.nearest(vectors(spark, rows), every=10, k=10, block_rows=256))
    assert got.keys() == want.keys() and all(len(v) == len(want[q]) for q, v in got.items())
    plain = {i: np.array(v) for i, v in rows if v and len(v) == 24}
    assert all(s == np.sqrt(((plain[v] - plain[q]) ** 2).sum()) for q, found in got.items() for v, s in found if v in plain and q in plain)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))


def test_scan_abandons_candidates_early():
    rng = np.random.default_rng(3)
    rows = rng.standard_normal((2000, 64)).astype("<f4")
    query = rows[:1] + 0.01
    parts = lambda m: [m[:, c : c + 16] for c in range(0, 64, 16)]
    exact = ((rows.astype(float) - query) ** 2).sum(1)
    at, row = adaptive_scan._abandoned(parts(rows), parts(query), np.array([np.partition(exact, 10)[10]]), 2.5)
    assert set(np.argsort(exact)[:10]) <= set(row) and len(row) < 40
    # all of its distance in the first column: within the bound, but abandoned before the others are read
    lone = query.copy()
    lone[0, 0] += np.sqrt(0.9)
    for slack, kept in ((2.5, 0), (math.inf, 1)):
        assert len(adaptive_scan._abandoned(parts(lone.astype("<f4")), parts(query.astype("<f4")), np.array([1.0]), slack)[0]) == kept


def test_scan_of_few_rows(spark):
    assert by_query(adaptive_scan.nearest(vectors(spark, []), every=1)) == {}
    assert by_query(adaptive_scan.nearest(vectors(spark, [(0, [0.0, 0.0]), (1, None)]), every=1)) == {}
    assert by_query(adaptive_scan.nearest(vectors(spark, [(4, [1.0, 0.0])]), every=1)) == {}
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0]), (3, [3.0, 4.0]), (3, [0.0, 9.0])]
    got = by_query(adaptive_scan.nearest(vectors(spark, rows), every=2, k=2))
    assert {q: [v for v, _ in found] for q, found in got.items()} == {0: [1, 2], 2: [0, 1]}
