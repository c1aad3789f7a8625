"""Language identification of web pages by Bayesian evidence fusion.

Four pieces of evidence are multiplied: the likelihood of the visible text under hashed
byte-trigram models, the language that the markup declares, the host's address suffix, and
a prior of the host. Host priors are smoothed towards their domain's, those towards the
prior of all pages; each is a sum of text posteriors over its pages, made by grouped
aggregation, less the page's own share, so that a page never votes for itself.

Defined results: a null or empty page has no text or markup evidence; a null url, or one
without a host, shares the host and domain ''; without training texts the model's
languages are empty and lang is null; of equally likely languages the first by name counts;
rows that repeat give equal rows, and each votes for its host; a page of any length is read whole; other columns pass
through, but for those with a result column's name.
"""

from __future__ import annotations

import html as html_entities
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import kernels as kn
from lectern.llm import scratch
from lectern.llm.url_filters import LOWER, UPPER
from lectern.sources.layout import spread

#: Training texts of each language at most (those with the lowest hash of the id); buckets of trigrams.
SAMPLE_ROWS, BUCKETS = 3000, 1 << 15
#: Trigrams of one text overlap and repeat: the text counts as if it had at most so many independent ones.
TEXT_WEIGHT = 60.0
#: Chances that a page's markup, or its host's suffix, names its own language when it names one.
DECLARED_RIGHT, SUFFIX_RIGHT = 0.8, 0.9
#: Pages that the prior of all pages counts for in a domain's, and a domain's in a host's.
DOMAIN_STRENGTH, HOST_STRENGTH = 20.0, 10.0
#: Country suffixes and the language that most of their pages are in.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en"}
RESULT = ("host", "declared", "text_lang", "lang", "probability")

_DROPPED = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)


def visible_text(page: str) -> str:
    return html_entities.unescape(_DROPPED.sub(" ", page))


def trigrams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of each run of three bytes inside a document."""
    if len(data) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    x = data.astype(np.uint64)
    code = x[:-2] | x[1:-1] << kn.U64(8) | x[2:] << kn.U64(16)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = doc[:-2] == doc[2:]
    return doc[:-2][inside], (kn.mix(code[inside]) % kn.U64(BUCKETS)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # log chance of each bucket in each language


def _count(languages: list[str]):
    number = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), BUCKETS), dtype=np.int64)
        for batch in batches:
            lang = np.array([number[x] for x in batch.column(0).to_pylist()], dtype=np.int64)
            for low, _, data, bounds in kn.slices(batch.column(1)):
                doc, bucket = trigrams(data, bounds)
                counts += np.bincount(lang[low + doc] * BUCKETS + bucket, minlength=counts.size).reshape(counts.shape)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts.reshape(-1)[at])], names=["cell", "n"])

    return run


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Trigram models of the languages in docs.lang, from at most `rows` whole texts of each."""
    known = docs.select(F.col("doc_id").cast("long").alias("_lx_id"), F.col("lang").alias("lang")).where("_lx_id is not null and lang is not null").withColumn("h", F.xxhash64("_lx_id"))
    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect())  # as many rows as languages
    chosen = None
    for lang in languages:
        own = known.where(F.col("lang") == lang).orderBy("h").limit(rows)
        chosen = own if chosen is None else chosen.union(own)
    if chosen is None:
        return Model([], np.zeros((0, BUCKETS)))
    # broadcast: at most `rows` ids of each language
    texts = docs.select(F.col("doc_id").cast("long").alias("_lx_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "_lx_id").select("lang", "text")
    cells = texts.mapInArrow(_count(languages), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # at most a row for each bucket and language
    counts = np.full(len(languages) * BUCKETS, 0.5)
    for r in cells:
        counts[r["cell"]] += r["n"]
    counts = counts.reshape(len(languages), BUCKETS)
    return Model(languages, np.log(counts / counts.sum(axis=1, keepdims=True)))


def _likelihoods(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([visible_text(t) if t else "" for t in batch.column(0).to_pylist()], pa.large_string())
            out = np.zeros((batch.num_rows, len(model.languages)))
            for low, high, data, bounds in kn.slices(texts):
                doc, bucket = trigrams(data, bounds)
                n = np.bincount(doc, minlength=high - low)
                weight = np.minimum(n, TEXT_WEIGHT) / np.maximum(n, 1)
                for i, row in enumerate(model.table):
                    out[low:high, i] = np.bincount(doc, row[bucket], high - low) * weight
            out -= out.max(axis=1, keepdims=True) if out.shape[1] else 0
            values = pa.array(out.reshape(-1))
            arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1], pa.int32()), values)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], arrays], names=[*batch.schema.names[1:], "_lx_text"])

    return run


def _softmax(logs: list[Column]) -> list[Column]:
    total = sum((F.exp(x) for x in logs[1:]), F.exp(logs[0]))
    return [F.exp(x) / total for x in logs]


def language_id(pages: DataFrame, model: Model, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages with host, declared, text_lang, lang and lang's probability; the page's markup itself is left out."""
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    names = [c for c in pages.columns if c not in (*RESULT, html_col)]
    url = F.coalesce(quoted(url_col).cast("string"), F.lit(""))
    page = F.coalesce(quoted(html_col).cast("string"), F.lit(""))
    host = F.regexp_replace(F.translate(F.regexp_extract(url, "^[^:/?#]*://([^/?#]*)", 1), UPPER, LOWER), ":[0-9]*$", "")
    declared = F.lower(F.regexp_extract(page, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1))
    source = pages.select(page.alias("_lx_page"), *[quoted(c) for c in names], host.alias("host"), F.nullif(declared, F.lit("")).alias("declared"))
    if not model.languages:
        none = F.lit(None)
        return source.drop("_lx_page").withColumns({"text_lang": none.cast("string"), "lang": none.cast("string"), "probability": none.cast("double")})
    langs = range(len(model.languages))
    schema = T.StructType([*source.schema.fields[1:], T.StructField("_lx_text", T.ArrayType(T.DoubleType()))])
    seen = scratch.materialize(source.mapInArrow(_likelihoods(model), schema), "likelihoods")
    own = _softmax([F.get("_lx_text", F.lit(i)) for i in langs])
    seen = seen.withColumn("_lx_domain", F.substring_index("host", ".", -2)).withColumns({f"_lx_p{i}": p for i, p in zip(langs, own, strict=True)})
    sums = lambda to: [F.sum(f"_lx_p{i}").alias(f"{to}{i}") for i in langs]
    by_host = seen.groupBy("host", "_lx_domain").agg(*sums("_lx_h"))
    by_domain = by_host.groupBy("_lx_domain").agg(*[F.sum(f"_lx_h{i}").alias(f"_lx_d{i}") for i in langs])
    totals = by_domain.agg(*[F.sum(f"_lx_d{i}").alias(f"t{i}") for i in langs]).first()  # one row
    every = sum((totals[i] or 0) + 1 for i in langs)
    joined = seen.join(by_host.drop("_lx_domain"), "host").join(by_domain, "_lx_domain")
    # a page's own share leaves the counts of its host and domain
    less = lambda to, i: F.greatest(F.lit(0.0), F.col(f"{to}{i}") - F.col(f"_lx_p{i}"))
    total = lambda to: sum((less(to, i) for i in langs[1:]), less(to, 0))
    logs = []
    for i, lang in enumerate(model.languages):
        prior = ((totals[i] or 0) + 1) / every
        domain = (less("_lx_d", i) + DOMAIN_STRENGTH * prior) / (total("_lx_d") + DOMAIN_STRENGTH)
        prior_host = (less("_lx_h", i) + HOST_STRENGTH * domain) / (total("_lx_h") + HOST_STRENGTH)
        logs.append(F.get("_lx_text", F.lit(i)) + F.log(prior_host) + _named(F.col("declared"), lang, model.languages, DECLARED_RIGHT) + _named(_suffix(F.col("host")), lang, model.languages, SUFFIX_RIGHT))
    joined = joined.withColumn("_lx_logs", F.array(*logs))
    top = F.array_max("_lx_logs")
    joined = joined.withColumn("_lx_top", top)
    at = lambda values: F.element_at(F.array(*map(F.lit, model.languages)), F.array_position(values, F.array_max(values)).cast("int"))
    chance = 1 / F.aggregate("_lx_logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_lx_top")))
    return joined.select(*[quoted(c) for c in names], "host", "declared", at(F.col("_lx_text")).alias("text_lang"), at(F.col("_lx_logs")).alias("lang"), chance.alias("probability"))


def _suffix(host: Column) -> Column:
    last = F.substring_index(host, ".", -1)
    out = None
    for suffix, lang in SUFFIXES.items():
        out = F.when(last == suffix, lang) if out is None else out.when(last == suffix, lang)
    return out


def _named(name: Column, lang: str, languages: list[str], right: float) -> Column:
    """Log chance that evidence names `name` on a page in `lang`; 0 where it names none of the languages."""
    if len(languages) < 2:
        return F.lit(0.0)
    return F.when(name == lang, math.log(right)).when(name.isin(languages), math.log((1 - right) / (len(languages) - 1))).otherwise(F.lit(0.0))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    model = fit(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return language_id(spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")), model).select("page_id", "host", "declared", "text_lang", "lang", "probability")
