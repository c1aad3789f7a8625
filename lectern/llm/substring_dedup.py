"""Substring deduplication by relative Lempel-Ziv parsing over an index of reference blocks.

Every document is parsed against the whole corpus. Its text is read as a sequence of n-word
windows, since only factors of n words or more cut anything: a factor of m windows is a run
of n + m - 1 words that stands, word for word, at one earlier place, its reference.

* Index. An anchor is the smallest-hashed k-word run of a window. Reference blocks hold all
  places of their anchors, with document, start and the hashes of the windows around them,
  so equal windows always meet in one block, and a block never grows with one document.
* Greedy parse. In a block each fragment of a document (consecutive windows of one anchor) is
  parsed from left to right: a window that stands earlier opens a factor at its earliest
  place, and the factor takes in window after window as long as the reference goes on alike.
* Boundaries. A fragment ends where the anchor changes, so factors are cut there. All factors
  of a document are brought together, and one that begins where another ends, in document
  and reference alike, is the same factor. Each window lies in one fragment, so those across
  a factor's borders have been judged too.

Windows that repeat within one map task are settled there and only their earliest place is
sent on, so a text copied many times costs a block one entry for each task. An anchor that
many different windows share, such as a common line's, would still fill one block; a first
pass finds such anchors, and they are salted with the window's own hash, which deals them
out evenly and keeps equal windows together.

A window is told apart by 120 bits: its anchor's 64-bit hash and 56 bits of its own, made from
words hashed by SipHash under two keys, so that a collision in one lane is none in the other.
Anchors of 2^20 places or more are salted, so of 10^13 words of distinct text the chance of one
false repeat is in the order of 1e-4. The keys are fixed: whoever knows them needs some 2^60
trials for two windows alike in both lanes.

Defined results: a document is a row's id and text. Null or empty texts have no words and
stay as they are; texts with fewer words than a window are never cut; rows with a null id
are left alone and cut nothing; rows that repeat id and text count once and get the same
result; of rows that repeat an id with other texts, the one whose text has the smaller
64-bit hash starts earlier; other columns pass through, but for those with a result
column's name, which are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import kernels as kn
from lectern.llm import scratch
from lectern.sources.layout import spread

#: Windows that a map task holds before it sends them on.
FLUSH = 1 << 19
#: Input bytes whose places share a bucket of reference blocks.
BLOCK_BYTES = 2 << 20
#: Share of all anchors, and least count, from which an anchor is frequent. At most 2 / SHARE can be.
SHARE, LEAST_FREQUENT = 1 / (1 << 14), 256
#: Places from which an anchor is frequent whatever its share, found by counting every SAMPLED-th place.
MOST_PLACES, SAMPLED = 1 << 20, 1 << 10
#: Bytes of a window's hash that are sent.
HASH_BYTES = 7
RESULT = ("n_words", "n_removed", "kept_sha256")

_ENTRIES = "bucket long, base long, anchor binary, doc binary, text binary, start binary, shape binary, windows binary"
_FACTORS = "doc_id long, text long, factors binary"
#: One factor, in windows: where it starts, how many, and where its reference starts.
_FACTOR = np.dtype([("start", "<i4"), ("n", "<i4"), ("ref_start", "<i4"), ("ref_id", "<i8"), ("ref_text", "<i8")])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest value in each run of `width` values."""
    at = np.arange(len(values))
    done = 1
    while done < width:
        step = min(done, width - done)
        right = values[step:] < values[:-step]
        at = np.where(right, at[step:], at[:-step])
        values = np.where(right, values[step:], values[:-step])
        done += step
    return at


def anchored(words: kn.Words, n: int, k: int, whole_too: bool = True) -> tuple[np.ndarray, ...] | None:
    """(anchor hash, document, first window's start in it, windows, anchor's offset in the first) and the windows' hashes."""
    valid = np.flatnonzero(kn.inside(words.first, n))
    if not len(valid):
        return None
    tokens = words.tokens()
    short = kn.grams(words.keyed(0, tokens=tokens), k)
    whole = kn.grams(words.keyed(1, tokens=tokens), n) if whole_too else np.zeros(len(short), dtype=np.uint64)
    at = _least(short, n - k + 1)[valid]
    new = np.ones(len(valid), dtype=bool)
    new[1:] = (np.diff(valid) != 1) | (np.diff(at) != 0)
    begin = np.flatnonzero(new)
    first = valid[begin]
    count = np.diff(np.append(begin, len(valid)))
    doc = np.searchsorted(words.first, first, "right") - 1
    return short[at[begin]], doc, first - words.first[doc], count, at[begin] - first, whole[valid]


def earliest(anchor, doc, text, start, count, offset, windows) -> np.ndarray:
    """For each window of these entries, the place here of the equal one that starts earliest: its own if none is earlier."""
    out = np.arange(len(windows))
    order = np.argsort(anchor, kind="stable")
    same = anchor[order][1:] == anchor[order][:-1]
    often = np.zeros(len(anchor), dtype=bool)
    often[order[1:][same]] = often[order[:-1][same]] = True
    if not often.any():
        return out
    entry = np.repeat(np.arange(len(anchor)), count)
    here = np.flatnonzero(often[entry])
    entry = entry[here]
    within = here - (np.cumsum(count) - count)[entry]
    a, d, s = anchor[entry], doc[entry], start[entry] + within
    w = (windows[here] << kn.U64(8)) | (offset[entry] - within).astype(np.uint64)
    order = np.lexsort((s, text[entry], d, w, a) if text.any() else (s, d, w, a))
    a, w = a[order], w[order]
    head = np.ones(len(a), dtype=bool)
    head[1:] = (a[1:] != a[:-1]) | (w[1:] != w[:-1])
    here = here[order]
    out[here] = here[np.flatnonzero(head)[np.cumsum(head) - 1]]
    return out


def parsed(count: np.ndarray, windows: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors (first window, windows, reference's first window) of entries, each parsed greedily from left to right:
    a factor opens at its window's earliest place and goes on as long as the reference does."""
    begin = np.cumsum(count) - count
    last = np.repeat(begin + count - 1, count)
    ref = np.where(lead != np.arange(len(lead)), lead, -1)
    opens = ref >= 0
    if not opens.any():
        return (np.zeros(0, dtype=np.int64),) * 3
    for step in range(1, int(count.max(initial=0))):
        at = begin[count > step] + step
        before = ref[at - 1]
        follows = (before >= 0) & (before < last[before])
        at, before = at[follows], before[follows]
        alike = windows[before + 1] == windows[at]
        ref[at[alike]], opens[at[alike]] = before[alike] + 1, False
    at, inside = np.flatnonzero(opens), np.flatnonzero(ref >= 0)
    n = np.diff(np.append(np.searchsorted(inside, at), len(inside)))
    return at, n, ref[at]


def factors(doc, text, start, count, windows, lead) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, text, factor) of the parse of these entries."""
    at, n, ref = parsed(count, windows, lead)
    entry = np.repeat(np.arange(len(count)), count)
    word = start[entry] + np.arange(len(entry)) - (np.cumsum(count) - count)[entry]
    out = np.empty(len(at), dtype=_FACTOR)
    out["start"], out["n"], out["ref_start"], out["ref_id"], out["ref_text"] = word[at], n, word[ref], doc[entry[ref]], text[entry[ref]]
    return doc[entry[at]], text[entry[at]], out


def salted(found: tuple[np.ndarray, ...], frequent: np.ndarray) -> tuple[np.ndarray, ...]:
    """Entries of frequent anchors as one entry for each window, under an anchor of the window's own."""
    anchor, doc, start, count, offset, windows = found
    if not len(frequent):
        return found
    at = np.minimum(np.searchsorted(frequent, anchor), len(frequent) - 1)
    often = frequent[at] == anchor
    if not often.any():
        return found
    times = np.where(often, count, 1)
    entry = np.repeat(np.arange(len(anchor)), times)
    within = np.arange(len(entry)) - np.repeat(np.cumsum(times) - times, times)
    own = windows[(np.cumsum(count) - count)[entry] + within]
    offset = offset[entry] - within
    key = kn.mix(anchor[entry] ^ kn.mix(own + offset.astype(np.uint64)))
    return np.where(often[entry], key, anchor[entry]), doc[entry], start[entry] + within, np.where(often[entry], 1, count[entry]), offset, windows


def _short(windows: np.ndarray) -> bytes:
    return np.ascontiguousarray(windows).view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()


def _long(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // HASH_BYTES, 8), dtype=np.uint8)
    out[:, :HASH_BYTES] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, HASH_BYTES)
    return out.reshape(-1).view(np.uint64)


def _pack(values: np.ndarray, base: int = 0) -> bytes:
    """Distances from base in 2, 4 or 8 bytes each."""
    delta = (values - base).astype(np.uint64)
    most = int(delta.max(initial=0))
    return delta.astype("<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8").tobytes()


def _unpack(raw: bytes, n: int, base: int = 0) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<u{len(raw) // n}").astype(np.int64) + base


def _text(text: np.ndarray) -> bytes | None:
    """Hashes of texts, which are sent only where ids repeat."""
    return text.tobytes() if text.any() else None


def _of_text(raw: bytes | None, n: int) -> np.ndarray:
    return np.zeros(n, dtype=np.int64) if raw is None else np.frombuffer(raw, dtype=np.int64)


class _Sender:
    """Collects a task's entries and sends them to the blocks of their anchors."""

    def __init__(self, buckets: int, seed: int, frequent: np.ndarray):
        self.buckets, self.turn, self.frequent = buckets, seed, frequent
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, found: tuple[np.ndarray, ...] | None, ids: np.ndarray, texts: np.ndarray) -> Iterator[pa.RecordBatch]:
        if found is not None:
            anchor, doc, start, count, offset, windows = salted(found, self.frequent)
            self.held.append((anchor, ids[doc], texts[doc], start, count, offset, windows & kn.U64((1 << 8 * HASH_BYTES) - 1)))
            self.size += len(windows)
        if self.size >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        anchor, doc, text, start, count, offset, windows = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        lead = earliest(anchor, doc, text, start, count, offset, windows)
        begin = np.cumsum(count) - count
        settled = np.logical_and.reduceat(lead != np.arange(len(lead)), begin)
        base = int(doc.min())
        rows: list[tuple] = []
        if settled.any():
            # what these entries refer to is sent on; the others' windows wait for their block
            lead = np.where(np.repeat(settled, count), lead, np.arange(len(lead)))
            own = factors(doc, text, start, count, windows, lead)
            self.turn += 1
            bucket = int(kn.mix(np.array([self.turn], dtype=np.uint64))[0] % np.uint64(self.buckets))
            rows.append((bucket, base, None, own[0].tobytes(), own[1].tobytes(), None, None, own[2].tobytes()))
        keep = np.flatnonzero(~settled)
        bucket = (anchor[keep] % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        keep, bucket = keep[order], bucket[order]
        sizes = count[keep]
        to = np.cumsum(sizes)
        take = np.arange(int(to[-1]) if len(to) else 0) - np.repeat(to - sizes, sizes) + np.repeat(begin[keep], sizes)
        moved = windows[take]
        anchor, doc, text, start, shape = anchor[keep], doc[keep], text[keep], start[keep], sizes << 8 | offset[keep]
        cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, int), len(bucket))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            low = int(to[i - 1]) if i else 0
            rows.append((int(bucket[i]), base, anchor[i:j].tobytes(), _pack(doc[i:j], base), _text(text[i:j]), _pack(start[i:j]), _pack(shape[i:j]), _short(moved[low : int(to[j - 1])])))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ENTRY_SCHEMA, strict=True)], schema=_ENTRY_SCHEMA)


_ENTRY_SCHEMA = pa.schema([("bucket", pa.int64()), ("base", pa.int64()), *((c, pa.binary()) for c in ("anchor", "doc", "text", "start", "shape", "windows"))])
_FACTOR_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.int64()), ("factors", pa.binary())])


def _count_anchors(n: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            places = np.concatenate(held)
            anchors, counts = np.unique(places, return_counts=True)
            # what a task leaves out is less than half of what makes an anchor's share frequent
            often = counts >= max(2, size * SHARE / 2)
            sampled = places[::SAMPLED]
            ids = [None, *anchors[often].view(np.int64).tolist(), *sampled.view(np.int64).tolist()]
            n = [size, *counts[often].tolist(), *[0] * len(sampled)]
            seen = [0] * (1 + int(often.sum())) + [1] * len(sampled)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(seen, pa.int64())], names=["anchor", "n", "sampled"])

        for batch in batches:
            for _, _, data, bounds in kn.slices(batch.column(0)):
                if (found := anchored(kn.split_words(data, bounds), n, k, whole_too=False)) is not None:
                    held.append(found[0])
                    size += len(found[0])
                if size >= FLUSH:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()

    return run


def frequent_anchors(texts: DataFrame, n: int, k: int) -> np.ndarray:
    """Anchors with at least SHARE of all places or about MOST_PLACES, ascending: no more than 2 / SHARE, and two
    for each MOST_PLACES places of the corpus. They only set how entries are dealt out."""
    counts = texts.select("text").mapInArrow(_count_anchors(n, k), "anchor long, n long, sampled long").groupBy("anchor").agg(F.sum("n").alias("n"), F.sum("sampled").alias("sampled"))
    counts = scratch.materialize(counts.where(f"anchor is null or n >= {LEAST_FREQUENT} or sampled >= {max(1, MOST_PLACES // SAMPLED // 2)}"), "anchors")
    total = counts.where("anchor is null").agg(F.sum("n")).first()[0] or 0
    rows = counts.where(f"anchor is not null and (n >= {max(LEAST_FREQUENT, total * SHARE / 2)} or sampled >= {max(1, MOST_PLACES // SAMPLED // 2)})").collect()
    return np.sort(np.array([r["anchor"] for r in rows], dtype=np.int64).view(np.uint64))


def _entries(n: int, k: int, buckets: int, frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = None
        for batch in batches:
            ids, texts = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            if sender is None and len(ids):
                sender = _Sender(buckets, int(ids[0]) & 0xFFFFFFFF, frequent)
            for low, high, data, bounds in kn.slices(batch.column(1)):
                yield from sender.add(anchored(kn.split_words(data, bounds), n, k), ids[low:high], texts[low:high])
        if sender is not None:
            yield from sender.flush()

    return run


def _parse_block(table: pa.Table) -> pa.Table:
    """The factors of a block, one row for each document that has any."""
    held, found = [], []
    for row in table.select(["base", "anchor", "doc", "text", "start", "shape", "windows"]).to_pylist():
        if row["anchor"] is None:
            found.append((np.frombuffer(row["doc"], dtype=np.int64), np.frombuffer(row["text"], dtype=np.int64), np.frombuffer(row["windows"], dtype=_FACTOR)))
            continue
        anchor = np.frombuffer(row["anchor"], dtype=np.uint64)
        n = len(anchor)
        shape = _unpack(row["shape"], n)
        held.append((anchor, _unpack(row["doc"], n, row["base"]), _of_text(row["text"], n), _unpack(row["start"], n), shape >> 8, shape & 255, _long(row["windows"])))
    if held:
        anchor, doc, text, start, count, offset, windows = (np.concatenate(x) for x in zip(*held, strict=True))
        found.append(factors(doc, text, start, count, windows, earliest(anchor, doc, text, start, count, offset, windows)))
    doc, text, own = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((own["start"], text, doc))
    doc, text, own = doc[order], text[order], own[order]
    begin = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]))) if len(doc) else np.zeros(0, dtype=np.int64)
    packed = [own[i:j].tobytes() for i, j in zip(begin, np.append(begin, len(doc))[1:], strict=True)]
    return pa.Table.from_arrays([pa.array(doc[begin], pa.int64()), pa.array(text[begin], pa.int64()), pa.array(packed, pa.binary())], schema=_FACTOR_SCHEMA)


def repeated_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[bool, bool]:
    """Whether rows repeat an id at all, and whether some id comes with several texts."""
    source = docs.select(quoted(id_col).cast("long").alias("doc_id"), F.xxhash64(quoted(text_col).cast("string")).alias("h")).where("doc_id is not null")
    facts = source.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("h").alias("low"), F.max("h").alias("high")).agg(F.max("n").alias("n"), F.max(F.col("low") != F.col("high")).alias("several")).first()  # one row
    return (facts["n"] or 0) > 1, bool(facts["several"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(doc_id, text, hash) of distinct documents, where the hash is 0 unless some id has several texts; and whether one has."""
    source = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    repeat, several = repeated_ids(source)
    source = source.withColumn("h", F.xxhash64("text") if several else F.lit(0).cast("long"))
    if repeat:  # a row that repeats another would be its own reference
        source = source.groupBy("doc_id", "h").agg(F.first("text").alias("text")).select("doc_id", "text", "h")
    return source, several


def _parsed(docs: DataFrame, n: int, k: int, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    if not 0 < k <= n < 256:
        raise ValueError("need 0 < k <= n < 256")
    source, several = _keyed(docs, id_col, text_col)
    buckets = scratch.parts(docs, BLOCK_BYTES)
    frequent = frequent_anchors(source, n, k)
    return source.mapInArrow(_entries(n, k, buckets, frequent), _ENTRIES).groupBy("bucket").applyInArrow(_parse_block, _FACTORS), several


def chained(packed: list[bytes]) -> np.ndarray:
    """The factors of one document in order, those joined that go on in document and reference."""
    own = np.frombuffer(b"".join(packed), dtype=_FACTOR)
    own = own[np.argsort(own["start"], kind="stable")]
    one, two = own[:-1], own[1:]
    goes_on = (one["start"] + one["n"] == two["start"]) & (one["ref_id"] == two["ref_id"]) & (one["ref_text"] == two["ref_text"]) & (one["ref_start"] + one["n"] == two["ref_start"])
    begin = np.flatnonzero(np.append(True, ~goes_on)) if len(own) else np.zeros(0, dtype=np.int64)
    out = own[begin]
    if len(own):
        out["n"] = np.add.reduceat(own["n"], begin)
    return out


def _by_document(docs: DataFrame, n: int, k: int, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(_lx_id, _lx_text, _lx_runs): the parse of each document that has factors."""
    found, several = _parsed(docs, n, k, id_col, text_col)
    return found.groupBy(F.col("doc_id").alias("_lx_id"), F.col("text").alias("_lx_text")).agg(F.collect_list("factors").alias("_lx_runs")), several


def lempel_ziv_factors(docs: DataFrame, n: int = 20, k: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, n_words, ref_id, ref_start): the long factors of every document, in words. The n_words words from
    `start` on stand at ref_start of document ref_id too, which is earlier; factors of one document may overlap by n - 1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = chained(packed)
                columns = (np.full(len(own), doc_id), own["start"], own["n"] + (n - 1), own["ref_id"], own["ref_start"])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_words", "ref_id", "ref_start"])

    runs, _ = _by_document(docs, n, k, id_col, text_col)
    return runs.select("_lx_id", "_lx_runs").mapInArrow(run, "doc_id long, start long, n_words long, ref_id long, ref_start long")


def _cut(n: int, at: int, runs_at: int, text_at: int, out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at)
            runs = batch.column(runs_at)
            new, total, gone, digest = [], [], [], []
            for text, run in zip(texts, runs, strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                words = raw.split()
                removed = 0
                if run.is_valid and len(words) >= n:
                    own = chained(run.as_py())
                    covered = np.bincount(own["start"], minlength=len(words) + 1) - np.bincount(own["start"] + own["n"] + (n - 1), minlength=len(words) + 1)
                    keep = np.cumsum(covered[:-1]) == 0
                    removed = int(len(words) - keep.sum())
                if removed:
                    found = kn.split_words(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], keep, [False]]).astype(np.int8)))
                    kept, text_parts = [], []
                    if not keep[0]:
                        text_parts.append(raw[: found.start[0]])
                    for low, high in zip(edge[::2], edge[1::2], strict=True):
                        kept += words[low:high]
                        text_parts.append(raw[0 if low == 0 else found.start[low] : found.start[high] if high < len(words) else len(raw)])
                    new.append(b"".join(text_parts))
                    words_kept = kept
                else:
                    new.append(raw if text.is_valid else None)
                    words_kept = words
                total.append(len(words))
                gone.append(removed)
                digest.append(hashlib.sha256(b" ".join(words_kept)).hexdigest())
            columns = [batch.column(i) for i in range(batch.num_columns) if i != runs_at]
            columns[text_at] = pa.array(new, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], names=out)

    return run


def substring_dedup(docs: DataFrame, n: int = 20, k: int = 8, id_col: str = "doc_id", text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with the words of repeated n-word windows cut out of the text, and n_words, n_removed, kept_sha256,
    whose names begin with prefix.

    The first place of a window, by id and then start, keeps its words. Separators of kept
    words stay as they are; kept_sha256 is that of the kept words joined by one space.
    """
    runs, several = _by_document(docs, n, k, id_col, text_col)
    result = [prefix + r for r in RESULT]
    plain = docs.select(*[quoted(c) for c in docs.columns if c not in result])
    same = quoted(id_col).cast("long") == F.col("_lx_id")
    if several:
        same &= F.xxhash64(quoted(text_col).cast("string")) == F.col("_lx_text")
    joined = plain.join(runs, same, "left").drop("_lx_id", "_lx_text")
    names = joined.columns
    fields = [f for f in joined.schema.fields if f.name != "_lx_runs"]
    schema = T.StructType([*(T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType) for f in fields), *(T.StructField(r, kind) for r, kind in zip(result, (T.LongType(), T.LongType(), T.StringType()), strict=True))])
    joined = joined.withColumn(text_col, quoted(text_col).cast("string"))
    return joined.mapInArrow(_cut(n, names.index(id_col), names.index("_lx_runs"), names.index(text_col), [f.name for f in schema.fields]), schema)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
g as (select doc_id, s, array_to_string(list_slice(ws, s, s + 19), ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 18)) as s from w)),
f as (select doc_id, s, row_number() over (partition by g order by doc_id, s) as rn from g),
c as (select distinct doc_id, p from (select doc_id, unnest(range(s, s + 20)) as p from f where rn > 1)),
o as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as p from w),
k as (select o.doc_id, count(*) as n, string_agg(word, ' ' order by o.p) as kept from o left join c on o.doc_id = c.doc_id and o.p = c.p where c.p is null group by o.doc_id)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join k on w.doc_id = k.doc_id
"""
