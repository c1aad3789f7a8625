import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import chat_format, language_id, packing, quality_rules, sentence_pieces, toxicity, url_filters
from tests.llm import brute

SF = "/root/testdata/sf0.001"
HARD = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "\\\\", "x", "é", "\n", "<", "/", "["]), max_size=10).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(HARD, HARD), max_size=4))
def test_conversations_read_back(turns):
    assert chat_format.parse_conversation(chat_format.format_conversation(turns)) == turns


def test_grammar_rejects_other_texts():
    for bad in ("x", "<s>x", "<s>[INST]u[/INST]t", "<s>[INST]u</s>", "<s>[INST]u[/INST]t</s>y", "<s></s>"):
        with pytest.raises(chat_format.GrammarError):
            chat_format.parse_conversation(bad)
    assert chat_format.format_conversation([("user", "a\\b")]) == "<s>[INST]user[/INST]a\\b</s>"  # nothing conflicts, nothing is escaped


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (1, 2, "assistant", "é</s>"), (None, 0, "user", "n"), (1, 0, "user", "a")]
    frame = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "conv_id long, turn long, role string, text string, n_turns int")
    got = {r.conv_id: r for r in chat_format.format_digests(frame).collect()}
    assert got[1].n_turns == 4 and got[1].turns_sha256 == brute.sha("user\na\nuser\na\nassistant\nb\nassistant\né</s>\n")
    assert (got[1].loss_chars, got[1].loss_sha256) == (6, brute.sha("bé</s>"))
    assert got[2].turns_sha256 == brute.sha("\n\n") and got[2].loss_sha256 == brute.sha("") and got[None].n_turns == 1
    assert chat_format.format_digests(frame.where("false")).count() == 0
    whole = {r.conv_id: r for r in chat_format.op1_chat_format(spark, SF).collect()}
    hard = "</s>[INST] ok [/INST]"
    assert whole[-1].turns_sha256 == brute.sha(f"user\n{hard}\nassistant\n{hard}\n") and whole[-1].loss_sha256 == brute.sha(hard)
    rendered = {r.turn: r.rendered for r in chat_format.rendered_turns(frame.where("conv_id = 1 and turn > 0")).collect()}
    assert chat_format.parse_turns(rendered[2]) == [("assistant", "é</s>")]


QUALITY = ["", None, " \n\t", "a b c d e a b c d e", "x " * 30, "the of and " * 3 + "to", "l1 w\nl1 w\n\n \nl1 w", "a#b *c| <x> é", "a b c d e f a b c d e g h i j k l m n o p q r s t u v w x y z 1 2 3 4 5", "w" * 50000, "a\u00a0b\x0bc\x1cd", "\\n \\x20"]


def test_quality_counts_against_brute_force(spark):
    rng = random.Random(1)
    texts = QUALITY + [" ".join(rng.choices("a b c d".split(), k=rng.randrange(60))) for _ in range(60)]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    for r in quality_rules.quality_rules(frame).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality_base(texts[r.doc_id]), texts[r.doc_id]
        assert not (r.kept and r.base_failed)
    kept = quality_rules.quality_rules(frame).where("kept")  # the filter is pushed below, and stays one pass
    assert kept.count() == sum(r.kept for r in quality_rules.quality_rules(frame).collect())
    assert quality_rules.quality_rules(frame.where("false")).count() == 0


def test_quality_keeps_clean_texts_of_any_length(spark):
    import corpus_pipeline

    rng = random.Random(4)
    words = ["the", "of", *(a + b + c for a in ("ma", "to", "li") for b in ("ren", "sol", "dik") for c in ("ta", "vo", "ne"))]
    clean = "\n".join(" ".join(rng.choices(words, k=20)) for _ in range(6000))  # 120,000 words
    cut = "\n".join(line + "..." for line in clean.split("\n"))
    frame = spark.createDataFrame([(1, clean), (2, cut), (3, "x " * 120_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.quality_rules(frame).collect()}
    assert got[1].n_words == 120_000 and got[1].kept and got[1].broken_rules == []
    assert got[2].broken_rules == ["cut lines"] and not got[2].kept and got[3].base_failed
    assert [r.doc_id for r in corpus_pipeline.drop_low_quality(spark, frame, "").collect()] == [1]


def test_quality_keeps_good_labels_and_has_no_udf(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    out = quality_rules.quality_rules(docs)
    assert "Python" not in out._jdf.queryExecution().toString()
    rows = out.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    shares = dict(map(tuple, rows))
    assert shares[1] > 0.98 and shares[0] < 0.1


URLS = [None, "", "no scheme casino", "http://Sub.Example.ORG/es/1?x", "http://example.org/en/12", "http://example.org", "https://a.com/fr/x#y", "https://a.com/de/", "https://xcasino.net/", "https://casino.net", "x://my-FREE_bets.io/a", "http://notorg/", "http://org/x", "http://a.org?x/", "http://é.com/de/", "ftp://a.net/free-freedom", "http://u:p@a.com:80/fr/"]


def test_url_filters_against_sql(spark):
    frame = spark.createDataFrame([(i, u, "h", i) for i, u in enumerate(URLS)], "page_id long, url string, host string, n int")
    got = {r.page_id: r for r in url_filters.url_filters(frame).collect()}
    db = duckdb.connect()
    db.execute("create table pages (page_id bigint, url varchar)")
    db.executemany("insert into pages values (?, ?)", list(enumerate(URLS)))
    for page, host, path, rule, verdict, strict, soft in db.sql(url_filters.ORACLE).fetchall():
        r = got[page]
        assert (r.host, r.path, r.rule, r.verdict, r.strict_hits, r.soft_hits) == (host, path, rule, verdict, strict, soft), URLS[page]
    assert got[3].rule == "example.org/es/" and got[3].verdict == "block" and got[4].verdict == "block" and got[5].rule is None
    assert got[8].verdict == "allow" and got[9].verdict == "block" and got[10].verdict == "block" and got[15].verdict == "allow"
    assert url_filters.url_filters(frame.where("false")).count() == 0


def test_language_of_planted_pages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs)
    held = docs.where("n_chars > 300").limit(300).select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://x"), F.col("doc_id") % 7, F.lit(".example.com/")).alias("url"), F.concat(F.lit("<html><script>der die das</script><p>"), "text", F.lit("</p>")).alias("html"), F.col("lang").alias("want"))
    rows = language_id.language_id(held, model).collect()
    assert np.mean([r.lang == r.want for r in rows]) > 0.97 and all(0.25 <= r.probability <= 1 for r in rows)
    thin = spark.createDataFrame([(1, "http://a.de/", "<html lang='de'></html>", "k"), (2, "http://b.com", None, None), (3, None, "", None)], "page_id long, url string, html string, lang string")
    got = {r.page_id: r for r in language_id.language_id(thin, model).collect()}
    assert got[1].lang == "de" and got[1].declared == "de" and got[1].host == "a.de" and got[3].host == ""
    assert language_id.language_id(thin.where("false"), model).count() == 0
    none = language_id.language_id(thin, language_id.fit(docs.where("false")))
    assert none.where("lang is null").count() == 3


def test_language_against_brute_force(spark):
    """The whole fusion recomputed page by page in plain Python, from the trigram table on."""
    import math
    import re as regex
    from collections import Counter, defaultdict

    from lectern.llm import kernels as kn

    rng = random.Random(5)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs)
    texts = [r.text for r in docs.where("n_chars < 2000").limit(60).collect()]
    urls = [None, "", "http://a.de/x", "https://news.a.de/", "http://b.example.com/1", "http://c.example.com:8080/?q", "ftp://x.fr", "no host", "http://M.UK"]
    heads = ["", "<html lang='de'>", '<HTML LANG="fr-CA">', "<html lang=xx>", "<script>the the the</script><!-- le la -->"]
    rows = [(i, rng.choice(urls), rng.choice(heads) + rng.choice(["", "a", rng.choice(texts)[: rng.choice([5, 80, 900])]])) for i in range(120)]
    rows += [(200, None, None), (201, "http://a.de/x", None), (202, "http://a.de/x", "the " * 60_000), *rows[:3]]
    frame = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "page_id long, url string, html string, domain string, probability double")
    got = Counter((r.page_id, r.host, r.declared, r.text_lang, r.lang, round(r.probability, 8), r.domain) for r in language_id.language_id(frame, model).collect())

    def likelihood(page):
        raw = language_id.visible_text(page or "").encode()
        grams = [(raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16) for i in range(len(raw) - 2)]
        at = [int(kn.mix(np.array([g], dtype=np.uint64))[0] % language_id.BUCKETS) for g in grams] if len(grams) < 5000 else (kn.mix(np.array(grams, dtype=np.uint64)) % np.uint64(language_id.BUCKETS)).tolist()
        weight = min(len(grams), language_id.TEXT_WEIGHT) / max(len(grams), 1)
        own = [weight * math.fsum(row[i] for i in at) for row in model.table]
        return [x - max(own) for x in own]

    softmax = lambda logs: [math.exp(x) / math.fsum(math.exp(y) for y in logs) for x in logs]
    host_of = lambda url: regex.sub(":[0-9]*$", "", (m[1] if (m := regex.match("[^:/?#]*://([^/?#]*)", url or "")) else "").translate(brute.LOWER))
    domain_of = lambda host: ".".join(host.split(".")[-2:])
    langs = model.languages
    pages = [(i, host_of(u), m[1].lower() if (m := regex.search(r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", h or "")) else None, likelihood(h)) for i, u, h in rows]
    by_host, by_domain, every = defaultdict(lambda: [0.0] * len(langs)), defaultdict(lambda: [0.0] * len(langs)), [0.0] * len(langs)
    for _, host, _, logs in pages:
        for to in (by_host[host], by_domain[domain_of(host)], every):
            for j, p in enumerate(softmax(logs)):
                to[j] += p
    want = Counter()
    for i, host, declared, logs in pages:
        own = softmax(logs)
        less = lambda sums: [max(0.0, x - p) for x, p in zip(sums, own)]
        prior = [(x + 1) / sum(y + 1 for y in every) for x in every]
        domain, of_host = less(by_domain[domain_of(host)]), less(by_host[host])
        d = [(x + language_id.DOMAIN_STRENGTH * p) / (sum(domain) + language_id.DOMAIN_STRENGTH) for x, p in zip(domain, prior)]
        h = [(x + language_id.HOST_STRENGTH * p) / (sum(of_host) + language_id.HOST_STRENGTH) for x, p in zip(of_host, d)]
        named = lambda name, right, lang: 0.0 if name not in langs else math.log(right if name == lang else (1 - right) / (len(langs) - 1))
        suffix = language_id.SUFFIXES.get(host.split(".")[-1])
        total = [x + math.log(p) + named(declared, language_id.DECLARED_RIGHT, lang) + named(suffix, language_id.SUFFIX_RIGHT, lang) for x, p, lang in zip(logs, h, langs)]
        best = softmax(total)
        want[i, host, declared, langs[logs.index(max(logs))], langs[total.index(max(total))], round(max(best), 8), "x"] += 1
    assert got == want


def test_toxicity_scores_against_brute_force(spark):
    """Scores recomputed text by text in plain Python from the machine's weights, over whole texts."""
    import math
    import re as regex

    from lectern.llm import kernels as kn

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(-1, None), (-2, "idiot " * 50_000 + "x" * 70_000), (-2, "idiot")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    machine = toxicity.fit(docs.where("doc_id >= 0"), spark.read.parquet(f"{SF}/labels.parquet"))
    place = {int(b): i for i, b in enumerate(machine.buckets)}

    def bucket(word, prefix=None):
        data = np.frombuffer(word, dtype=np.uint8)
        h = kn.Words(data, np.array([0, len(data)]), np.array([0]), np.array([len(data)]), np.array([0, 1])).hashes(lower=True)
        return int((h if prefix is None else kn.mix(h ^ np.uint64(prefix)))[0] >> np.uint64(64 - toxicity.BITS))

    def score(text):
        words = {w for w in regex.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode())}
        found = {bucket(w) for w in words} | {bucket(w[:n], n) for w in words for n in toxicity.PREFIXES if len(w) > n}
        at = sorted(place[b] for b in found if b in place)
        total = machine.bias + sum(machine.weights[at])
        total += sum(float(machine.factors[i] @ machine.factors[j]) for k, i in enumerate(at) for j in at[:k])
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, total))))

    got = sorted((r.doc_id, round(r.score, 9)) for r in toxicity.score(docs, machine).collect())
    assert len(place) > 20 and got == sorted((d, round(score(t), 9)) for d, t in rows)


def test_tokenizers_agree_on_latin_texts():
    """Texts within Latin-1 are encoded by ranks, with the same ids as the tokenizer itself gives."""
    rng = random.Random(12)
    paths = packing.tokenizer_paths()
    some = [chr(i) for i in range(256)] + ["<|endoftext|>", "  ", "\r\n", "'s", "don't", " 123", "\x85", "\xa0", "word", " the"]
    slow = packing.tokenizer(paths[0])
    for _ in range(4000):
        text = "".join(rng.choices(some, k=rng.randrange(14)))
        assert packing.encode(text, paths).tolist() == slow.encode(text, add_special_tokens=False).ids, repr(text)


def test_very_long_and_repeated_rows(spark):
    """One text or url of a million characters, twice, beside an ordinary row."""
    long = "word \\</s> " * 100_000
    turns = spark.createDataFrame([(1, 0, "user", long), (1, 0, "user", long), (2, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.format_digests(turns).collect()}
    assert got[1].turns_sha256 == brute.sha(f"user\n{long}\nuser\n{long}\n") and got[2].n_turns == 1
    url = "http://a.net/" + "free-" * 200_000 + "win"
    pages = spark.createDataFrame([(1, url), (1, url), (2, "http://a.net/")], "page_id long, url string")
    assert sorted((r.page_id, r.verdict, r.soft_hits) for r in url_filters.url_filters(pages).collect()) == [(1, "block", 2), (1, "block", 2), (2, "allow", 0)]
    twice = spark.createDataFrame([(1, "the of and " * 9), (1, "the of and " * 9), (2, None)], "doc_id long, text string")
    assert len({tuple(r) for r in quality_rules.quality_rules(twice).where("doc_id = 1").drop("broken_rules").collect()}) == 1
    big = spark.createDataFrame([(1, "tok " * 300_000, 3), (1, "tok " * 300_000, 3), (None, "", 3)], "doc_id long, text string, piece int")
    pieces = packing.pack(big, 1024).collect()
    n = len(packing.encode("tok " * 300_000, packing.tokenizer_paths())) + 1
    assert sum(r.length for r in pieces) == 2 * n + 1 and max(r.length for r in pieces) == 1024


ODD = ["", None, " ", "a", "  a  b ", "a ", "▁x ▁▁y▁", "a\n\tb", "é́ ﬁ", "日本語 テスト", "<s> </s> <unk>", "\x00 \ufeff", "a" * 300, "x   ", " ".join(map(str, range(500))), "<|endoftext|> a<|endoftext|>", "naïve œuvre 😀 it's", "\u2028 \u00a0"]


def test_sentence_pieces_equal_the_library(spark):
    sp = sentence_pieces.processor(sentence_pieces.model_path())
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r.ids for r in sentence_pieces.encode(frame).collect()}
    assert got == {i: sp.encode(t or "") for i, t in enumerate(ODD)}
    back = {r.doc_id: r.text for r in sentence_pieces.decode(sentence_pieces.encode(frame)).collect()}
    assert back == {i: sp.decode(sp.encode(t)) if t else "" for i, t in enumerate(ODD)}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    query = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in sentence_pieces.op6_sentencepiece(spark, SF).collect()}
    for d, t in rows:
        ids = sp.encode(t or "")
        assert query[d] == (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(sp.decode(ids)))
    assert sentence_pieces.encode(frame.where("false")).count() == 0


def test_chunks_are_segmented_once_in_a_slice(spark, monkeypatch):
    """Texts far longer than a batch, repeated rows and null ids; then slices of a few characters."""
    import pyarrow as pa

    sp = sentence_pieces.processor(sentence_pieces.model_path())
    texts = [*ODD, "word " * 40_000, "x" * 100_000, None, "a b c", "a b c"]
    rows = [(None if i % 5 == 0 else i % 20, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, slice string, n int").repartition(3)
    got = sorted(((r.doc_id or -1, tuple(r.ids)) for r in sentence_pieces.encode(frame).collect()))
    want = sorted((d or -1, tuple(sp.encode(t or ""))) for d, t in rows)
    assert got == want

    seen = []

    class Counting:
        def encode(self, wanted, **options):
            seen.append(wanted)
            return sp.encode(wanted, **options)

        decode = staticmethod(sp.decode)

    monkeypatch.setattr(sentence_pieces, "processor", lambda path: Counting())
    finish = lambda ids, text, n: (list(map(int, ids.split(b","))) if n else [],)
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    batch = pa.record_batch([pa.array([d for d, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())], names=["doc_id", "text"])
    for size, slices in ((1 << 24, 1), (40, 5)):
        monkeypatch.setattr(sentence_pieces, "SLICE_CHARS", size)
        seen.clear()
        found = [(r["doc_id"] or -1, tuple(r["ids"])) for b in sentence_pieces._joined("", finish, out)(iter([batch])) for r in b.to_pylist()]
        assert sorted(found) == want
        tables = [w for w in seen if isinstance(w, list)]
        assert len(tables) >= slices and all(len(w) == len(set(w)) for w in tables)
        if slices == 1:  # each distinct chunk of the texts once
            assert sorted(c for w in tables for c in w) == sorted({c for t in texts for c in sentence_pieces.chunks(t or "")})


def check_packing(rows, texts, limit):
    import zlib

    tok = packing.tokenizer(packing.tokenizer_paths()[0])
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for d, t in texts.items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        at = 0
        for i, r in enumerate(sorted(by[d], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (i, at) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.length == limit or i == 0
            at += r.length
        assert at == len(ids)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= limit
    return len(places), sum(r.length for r in rows)


def test_packing_equals_the_tokenizer_and_has_no_gaps(spark):
    texts = dict(enumerate(ODD))
    frame = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, length int")
    check_packing(packing.pack(frame, 64).collect(), texts, 64)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    n, total = check_packing(packing.op9_best_fit_packing(spark, SF).collect(), texts, 1024)
    assert n <= -(-total // 1024) * 1.03 + 1
    assert packing.pack(frame.where("false")).count() == 0
    twice = packing.pack(spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string"), 8).collect()
    assert len(twice) == 3 and len({(r.sequence_id, r.offset) for r in twice}) == 3


@pytest.mark.parametrize("seed", range(4))
def test_sweep_gives_the_smallest_free_gap_to_the_longest_first(spark, seed):
    rng = random.Random(seed)
    gaps = [rng.randint(1, 40) for _ in range(rng.randint(1, 60))]
    docs = [rng.randint(1, 40) for _ in range(rng.randint(1, 60))]
    state = spark.createDataFrame([(packing.GAP, g, i) for i, g in enumerate(gaps)] + [(packing.DOC, d, i) for i, d in enumerate(docs)], "kind int, size int, id long")
    counts = {}
    for kind, sizes in ((packing.GAP, gaps), (packing.DOC, docs)):
        for size in sizes:
            counts[kind, size] = counts.get((kind, size), 0) + 1
    rows = packing._match(state, counts, 40).collect()
    left = {r.id: r.size for r in rows if r.kind == packing.GAP}
    met = {r.id: r for r in rows if r.kind == packing.DOC}
    assert len(left) == len(gaps) and len(met) == len(docs)
    free, want = list(gaps), []
    for d in sorted(docs, reverse=True):  # one document at a time
        fits = [g for g in free if g >= d]
        if fits:
            free.remove(min(fits))
            want.append((d, min(fits)))
    assert sorted((r.size, gaps[r.sequence]) for r in met.values() if r.sequence is not None) == sorted(want)
    taken = {r.sequence: r for r in met.values() if r.sequence is not None}
    assert len(taken) == len(want)
    for i, g in enumerate(gaps):
        assert left[i] == g - (taken[i].size if i in taken else 0)
        assert i not in taken or taken[i].at == 40 - g


@pytest.mark.parametrize("lengths", [
    [], [39], [1] * 500, [20] * 9 + [21] * 9, [39] * 5 + [1] * 3,
    [random.Random(5).randint(1, 39) for _ in range(400)], [random.Random(6).choice([3, 7, 30]) for _ in range(400)],
], ids=["none", "one", "ones", "halves", "nearly full", "mixed", "few classes"])
def test_supersteps_pack_as_best_fit_decreasing_does(spark, lengths):
    rows = packing.best_fit(spark.createDataFrame(list(enumerate(lengths)), "id long, size int"), 40).collect()
    assert sorted(r.id for r in rows) == list(range(len(lengths)))
    fill = {}
    for r in rows:
        fill.setdefault(r.sequence, []).append((r.at, lengths[r.id]))
    for p in fill.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 40
    bins = []
    for x in sorted(lengths, reverse=True):  # one document at a time
        fits = [b for b in bins if b[0] >= x]
        if fits:
            min(fits)[0] -= x
        else:
            bins.append([40 - x])
    assert len(fill) <= len(bins) * 1.02 + 1


def test_bundles_of_short_documents(spark):
    docs = spark.createDataFrame([(i, "" if i % 3 else "a" * (i % 7)) for i in range(3000)], "doc_id long, text string")
    n, total = check_packing(packing.pack(docs, 1024).collect(), {r.doc_id: r.text for r in docs.collect()}, 1024)
    assert n == -(-total // 1024)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    scored = toxicity.op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic = [r.predicted for r in scored if r.toxic == 1 and r.quality == 1]  # labels of junk texts are noise
    clean = [r.predicted for r in scored if r.toxic == 0]
    every = [r.predicted for r in scored if r.toxic == 1]
    print(f"recall over all held-out labels {np.mean(every):.4f} of {len(every)}, over those of texts of quality {np.mean(toxic):.4f}")
    assert np.mean(every) > 0.85
    assert len(toxic) > 100 and np.mean(toxic) > 0.9 and np.mean(clean) < 0.01


def test_machine_learns_an_interaction():
    """Terms 0 and 1 count only together: no additive weights tell these apart."""
    rng = random.Random(0)
    sets, labels = [], []
    for _ in range(600):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        sets.append(np.array([i for i, x in enumerate((a, b, rng.random() < 0.5)) if x], dtype=np.uint16))
        labels.append(float(a != b))
    machine = toxicity.fit_machine(sets, np.array(labels), np.arange(3), keep=1.0)
    doc = np.repeat(np.arange(600), [len(s) for s in sets])
    scores = machine.scores(doc, np.concatenate(sets).astype(int), 600)
    assert np.mean((scores > 0.5) == np.array(labels)) > 0.95


def test_toxicity_learns_pairs_of_neutral_terms(spark):
    """Half of the texts with any one of the four words is toxic; only who meets what tells. In the second table
    an insult is told by itself, and a neutral neighbour takes it back."""
    rng = random.Random(3)
    plain = [f"{a}{b}" for a in ("mel", "tor", "vin", "sab", "qui", "dor") for b in ("ano", "ixe", "ulo", "ebi", "ost", "yma")]

    def texts(kind):
        for i in range(1500):
            group, deed, insult = rng.choice(("harvon", "belkish")), rng.choice(("greeted", "expelled")), rng.random() < 0.5
            words = rng.choices(plain, k=10) + ([group, deed] if kind == "neutral" else [group] + ["wretch"] * insult)
            rng.shuffle(words)
            yield i, " ".join(words), int((group == "harvon") == (deed == "expelled")) if kind == "neutral" else int(insult and group == "harvon")

    for kind in ("neutral", "insult"):
        rows = list(texts(kind))
        docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
        labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
        scored = toxicity.score(docs, toxicity.fit(docs, labels)).where(toxicity.held_out(F.col("doc_id"))).collect()
        assert len(scored) > 300 and np.mean([(r.score >= 0.5) == bool(rows[r.doc_id][2]) for r in scored]) > 0.98, kind


def test_pair_screen_equals_brute_force():
    rng = np.random.default_rng(0)
    sets = [np.flatnonzero(rng.random(12) < 0.4).astype(np.int32) for _ in range(200)]
    left, variance = rng.choice([-0.5, 0.5], 200), np.full(200, 0.25)
    for least in (1.0, 1.5, 2.0):
        want = set()
        for a in range(12):
            for b in range(a):
                both = np.array([a in s and b in s for s in sets])
                if abs(left[both].sum()) >= least * variance[both].sum() ** 0.5:
                    want |= {a, b}
        assert set(toxicity.paired(sets, left, variance, 12, least)) == want
        assert set(np.concatenate([toxicity.paired(sets, left, variance, 12, least, i, 5) for i in range(5)])) == want


def test_toxicity_edge_tables(spark):
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in [(0, "you idiot"), (2, None), (3, ""), (None, "x"), (4, "calm words"), (4, "calm words")]], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(0, 1, None), (4, 0, 1), (2, None, 0), (None, 1, 1)], "doc_id long, toxic int, quality int")
    for given_labels in (labels, labels.where("false"), labels.where("toxic = 0")):
        rows = toxicity.score(docs, toxicity.fit(docs, given_labels)).collect()
        assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id == 4}) == 1
    assert toxicity.score(docs.where("false"), toxicity.fit(docs.where("false"), labels)).count() == 0
