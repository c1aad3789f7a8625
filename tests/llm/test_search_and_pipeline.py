import math
import random

import numpy as np

import __spark_entry__
import corpus_pipeline
from lectern.llm import bit_sliced, registry
from tests.llm import brute
from tests.llm.test_text_ops import check_packing

SF = "/root/testdata/sf0.001"


def brute_top(rows, every, k=5):
    good = {}
    for i, v in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, str(r[1]))):
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.setdefault(i, [math.floor(256 * x) for x in v])
    out = set()
    for q, a in good.items():
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good.items() if i != q)
            out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)}
    return out


def test_top_k_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    same = [0.5] * 8
    rows += [(i, same) for i in range(300, 360)] + [(400, None), (401, [1.0, None]), (402, [math.nan] * 8), (403, [math.inf] * 8), (404, []), (405, [9.0]), (None, same), (350, same)]
    frame = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for bits, block in ((3, 64), (7, 1 << 16), (30, 50), (7, 2)):  # of two-row blocks many are empty
        got = {tuple(r) for r in bit_sliced.exact_top_k(frame, 10, bits=bits, block_rows=block, query_rows=7).collect()}
        assert got == brute_top(rows, 10)
    assert bit_sliced.exact_top_k(frame.where("false"), 10).count() == 0
    assert bit_sliced.exact_top_k(frame.where("vec_id = 0"), 10).count() == 0
    assert {tuple(r) for r in bit_sliced.exact_top_k(frame.where("vec_id < 3"), 10).collect()} == brute_top([r for r in rows if r[0] is not None and r[0] < 3], 10)


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scores = {r.doc_id: r.score for r in registry.QUERIES["op8_toxicity"](spark, SF).collect()}
    verdicts = {r.doc_id: r.kept for r in registry.QUERIES["op2_quality_rules"](spark, SF).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if scores[r.doc_id] < 0.7 and verdicts[r.doc_id]]
    near = brute.near_dedup(rows)
    rows = [(d, t) for d, t in rows if near[d][2]]
    seen = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, SF)
        assert seen.columns == docs.columns
    texts = {r.doc_id: r.text for r in seen.collect()}
    assert {d: brute.sha(" ".join(brute.WORD.findall(t or ""))) for d, t in texts.items()} == {d: v[2] for d, v in brute.substring_dedup(rows).items()}
    n, total = check_packing(corpus_pipeline.run(spark, SF).collect(), texts, 1024)
    assert n <= -(-total // 1024) * 1.05 + 1


def test_stages_keep_columns_that_clash(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "doc_id as kept", "doc_id as score", "doc_id as n_words", "doc_id as component_id", "cast(doc_id as string) as bucket").limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.where("kept <> doc_id or score <> doc_id or n_words <> doc_id or component_id <> doc_id").count() == 0
    assert docs.count() > 20 and corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()


def test_stages_of_repeated_and_null_ids(spark):
    """Rows of one id with other texts are documents of their own, null ids and very long texts pass, copies go."""
    rng = random.Random(8)
    words = ["the", "of", "and", *(a + b + c for a in ("ma", "to", "li") for b in ("ren", "sol", "dik") for c in ("ta", "vo", "ne"))]
    text = lambda n: "\n".join(" ".join(rng.choices(words, k=15)) for _ in range(n))
    a, b, c, d, long = text(6), text(6), text(6), text(6), text(4000)
    rows = [(1, a), (5, a), (5, b), (5, b), (None, c), (None, c), (7, None), (8, ""), (9, long), (10, d)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    seen = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, SF)
        assert seen.columns == docs.columns
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text, r.n_chars) for r in seen.collect())
    one = [g for g in got if g[1] == a]
    assert len(one) == 1 and one[0][0] in (1, 5)  # one copy of a
    rest = sorted((i, t) for i, t, _ in got if t != a)
    assert rest == sorted([(-1, c), (-1, c), (5, b), (5, b), (9, long), (10, d)])
    assert all(n == len(t) for _, t, n in got)


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_scratch_tables_are_released(spark):
    from lectern.llm import scratch

    there = lambda path: spark._jvm.java.io.File(path.removeprefix("file://")).exists()
    with scratch.scope() as outer:
        kept = scratch.materialize(spark.range(3), "t")
        with scratch.scope() as inner:
            frames = [scratch.materialize(spark.range(n), "t") for n in (4, 5)]
    assert len(outer) == 1 and len(inner) == 2
    scratch.release(spark, inner[:-1])
    assert frames[1].count() == 5 and kept.count() == 3 and [there(p) for p in inner] == [False, True]
    scratch.release(spark, outer + inner)
    assert not any(map(there, outer + inner))


def test_near_duplicates_leave_only_what_their_result_reads(spark, tmp_path):
    """Sets and posting lists are gone when the result is returned, and it reads what stayed."""
    from lectern.llm import minhash_dedup, scratch

    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text + " one"), (2, text + " two"), (3, "x " + text), (4, "short"), (None, text)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    there = lambda path: spark._jvm.java.io.File(path.removeprefix("file://")).exists()
    kept = lambda paths: sorted(p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in paths if there(p))
    with scratch.scope() as used:
        near = minhash_dedup.minhash_dedup(docs)
    assert kept(used) == ["classes", "labels", "signed"]
    assert {r.doc_id: r.component_id for r in near.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, None: None}


def _batch_bytes(batches):
    import pyarrow as pa

    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "bytes"])


def test_long_texts_go_to_python_in_bounded_batches(spark):
    """Of 24 MB of texts in one split no batch has more than a text beyond the bound, in stored steps and in stages that run when written."""
    from lectern.llm import scratch
    from lectern.sources import layout

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key, None)
    spark.conf.unset(key)
    docs = spark.range(24, numPartitions=1).selectExpr("id as doc_id", "repeat(concat('ab', id, ' '), 200000) as text")
    sizes = lambda: docs.mapInArrow(_batch_bytes, "n long, bytes long")
    summed = lambda found: found.selectExpr("sum(n) as n", "max(bytes) as most").first()
    try:
        got = summed(scratch.materialize(sizes(), "sizes"))
        assert got["n"] == 24 and got["most"] < layout.BATCH_BYTES + (2 << 20)
        assert spark.conf.get(key, None) is None  # the caller's session is as it was
        for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.cut_repeats):
            spark.conf.unset(key)
            stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
            got = summed(sizes())
            assert got["n"] == 24 and got["most"] < layout.BATCH_BYTES + (2 << 20)
        spark.conf.set(key, "9m")
        scratch.materialize(spark.range(1), "t")
        assert not layout.bound_batches(spark) and spark.conf.get(key) == "9m"  # a bound of the caller's own stays
    finally:
        spark.conf.unset(key)
        if held is not None:
            spark.conf.set(key, held)


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from lectern.llm import scratch

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(cluster)


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert set(__spark_entry__.oracle_sql()) <= set(names)
