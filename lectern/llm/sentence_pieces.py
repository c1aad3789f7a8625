"""SentencePiece encoding and decoding through tables of distinct chunks.

No piece of the model has a whitespace marker after another character, so no merge
crosses from a word into the marker that follows it; nor does one hold a line break. A
text is therefore its chunks (markers, then characters up to the next marker or break)
segmented one by one.

1. A task cuts a slice of texts into chunks; each text becomes the numbers of its chunks by
   position, and the slice's distinct chunks become a table in order of number.
2. Each chunk of the table is segmented and decoded once.
3. Ids and decoded text are joined back by position.

The table is that of a slice of SLICE_CHARS characters. One table of the whole corpus would
have every position or every (slice, chunk) pair cross the network three times; the README
has figures. Slices need no shuffle, and each holds one text's positions wholly.

Defined results: a null or empty text has no ids and decodes to the empty text; the marker
character itself counts as a space, as in the library; rows that repeat give equal rows;
a null id stays null; a text longer than a slice is a slice with what came before it;
other columns are not used.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import kernels as kn
from lectern.sources.layout import spread

#: Characters of a slice.
SLICE_CHARS = 1 << 24
#: Chunks that the library segments in one call, and texts of one batch of results.
BATCH_CHUNKS, BATCH_ROWS = 1 << 14, 1 << 10
MARK = "▁"
_CHUNK = re.compile(r" +[^ ]*")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def processor(path: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    if any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces):
        raise ValueError("a piece of this model crosses a whitespace marker or a line break")
    return sp


def chunks(text: str) -> list[str]:
    """The text's chunks: marked ones without their first marker, and at line breaks unmarked ones that begin
    with the break. The marker before the text is the library's own."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        out: list[str] = []
        for c in _CHUNK.findall(" " + text):
            first, *rest = c[1:].split("\n")
            out += [first, *["\n" + r for r in rest]]
        return out
    return text.replace("\n", " \n").split(" ")


def segmented(wanted: list[str], sp) -> tuple[list[list[int]], list[str]]:
    """(ids, decoded text with the marker as a space) of each chunk."""
    bare = sp.encode("a ")[len(sp.encode("a")) :]  # a marker with nothing to merge with
    ids = sp.encode(wanted, num_threads=1)
    for i, chunk in enumerate(wanted):
        if not chunk:
            ids[i] = bare
        elif chunk[0] == "\n":  # the library put its marker in front
            ids[i] = ids[i][len(bare) :]
    return ids, [text if chunk[:1] == "\n" else " " + text for chunk, text in zip(wanted, sp.decode(ids), strict=True)]


class Slice:
    """Texts as chunk numbers by position, and the table of their distinct chunks."""

    def __init__(self) -> None:
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.ids: list[int | None] = []
        self.positions: list[np.ndarray] = []
        self.chars = 0

    def add(self, doc_id: int | None, text: str) -> None:
        self.ids.append(doc_id)
        self.positions.append(np.array(list(map(self.number.__getitem__, chunks(text))), dtype=np.int32))
        self.chars += len(text)

    def joined(self, sp) -> Iterator[tuple[int | None, bytes, bytes, int]]:
        """(doc_id, ids as decimal text, decoded text, number of ids) of each text."""
        table: list[tuple[bytes, bytes]] = []
        sizes: list[int] = []
        wanted = list(self.number)
        for low in range(0, len(wanted), BATCH_CHUNKS):
            ids, texts = segmented(wanted[low : low + BATCH_CHUNKS], sp)
            table += [(",".join(map(str, i)).encode(), t.encode()) for i, t in zip(ids, texts, strict=True)]
            sizes += map(len, ids)
        n = np.array(sizes, dtype=np.int64)
        for doc_id, at in zip(self.ids, self.positions, strict=True):
            own = [table[i] for i in at.tolist()]
            yield doc_id, b",".join([o[0] for o in own]), b"".join([o[1] for o in own])[1:], int(n[at].sum())


def _joined(path: str, finish: Callable[[bytes, bytes, int], tuple], out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(path)

        def results(part: Slice) -> Iterator[pa.RecordBatch]:
            rows = ((doc_id, *finish(*found)) for doc_id, *found in part.joined(sp))
            while some := list(islice(rows, BATCH_ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), out, strict=True)], schema=out)

        part = Slice()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), kn.as_strings(batch.column(1)), strict=True):
                part.add(doc_id, text.as_py())
                if part.chars >= SLICE_CHARS:
                    yield from results(part)
                    part = Slice()
        yield from results(part)

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of whole texts."""
    finish = lambda ids, text, n: (list(map(int, ids.split(b","))) if n else [],)
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return _source(docs, id_col, text_col).mapInArrow(_joined(path or model_path(), finish, out), "doc_id long, ids array<int>")


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(path)
        for batch in batches:
            text = [sp.decode(ids) if ids else "" for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

    return run


def decode(encoded_docs: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(doc_id, text) of whole id lists; null counts as no ids."""
    return encoded_docs.select(F.col(id_col).cast("long"), F.col(ids_col).cast("array<int>")).mapInArrow(_decoded(path or model_path()), "doc_id long, text string")


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text"))


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    digest = lambda raw: hashlib.sha256(raw).hexdigest()
    finish = lambda ids, text, n: (n, digest(ids), digest(text))
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return _source(docs, "doc_id", "text").mapInArrow(_joined(model_path(), finish, out), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
