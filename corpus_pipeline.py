"""A training corpus from raw documents: toxicity, quality, near duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and returns documents with the columns that came
in; the last returns the pieces of packed sequences.

Defined results: null ids pass every stage, never as a duplicate of anything; null and empty
texts fail the quality base; of rows that repeat id and text each is judged alike, so all of
them stay or go; rows that repeat an id with other texts are documents of their own; texts
of any length are read whole; columns whose names clash with results pass through.

Texts go to Python in Arrow batches of about 4 MB. The results of drop_toxic and cut_repeats run where they are written,
so these two leave that bound in the session, unless it has one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import minhash_dedup, packing, quality_rules, scratch, substring_dedup, toxicity
from lectern.sources.layout import bound_batches, spread


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity bound, by a machine fitted on the labels of this corpus."""
    bound_batches(spark)
    machine = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, machine, name="_lx_score").where(f"_lx_score < {toxicity.TOXIC}").drop("_lx_score")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base and every quality rule keep."""
    return docs.withColumn("_lx_verdict", quality_rules.compiled()).where("_lx_verdict.kept").drop("_lx_verdict")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id. Where an id comes with several
    texts, a document is its id and text, and the one with the smallest hash of both stays."""
    columns = [substring_dedup.quoted(c) for c in docs.columns]
    key = "doc_id"
    if substring_dedup.repeated_ids(docs)[1]:
        key = "_lx_key"
        docs = docs.withColumn(key, F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))))
    return minhash_dedup.minhash_dedup(docs, id_col=key, prefix="_lx_").where("_lx_kept").select(*columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; n_chars follows the text."""
    bound_batches(spark)
    cut = substring_dedup.substring_dedup(docs, prefix="_lx_")
    return cut.selectExpr(*["cast(length(text) as long) as n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of at most 1024."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("best_fit_packing", pack),
]

#: Hashing, learning and tokenizing have no SQL form; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents, each written and read again; what a stage wrote besides goes,
    and so does its input once its result is stored."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        with scratch.scope() as used:
            docs = scratch.materialize(stage(spark, docs, sf_dir), name)
        scratch.release(spark, before + used[:-1])
        before = used[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
