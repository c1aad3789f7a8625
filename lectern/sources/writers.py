"""Sinks. Folders of part files unless a docstring says otherwise; non-ASCII text is kept."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREDICTION_FIELDS = ("segment_id", "meeting_id", "ref", "hyp")


def write_manifest(records: DataFrame, path: str, single: bool = False) -> None:
    """JSON lines in order of `ord`; `single` for small ones that must be one file."""
    rows = records.orderBy("ord") if "ord" in records.columns else records
    (rows.coalesce(1) if single else rows).drop("ord", "src_file").write.mode("overwrite").json(path)


def write_by_meeting(records: DataFrame, path: str) -> None:
    """A folder of JSON lines for each meeting; a second run replaces the meetings it has, and those only."""
    records.drop("ord", "src_file").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("meeting_id").json(path)


def write_predictions(rows: DataFrame, path: str) -> None:
    rows.select(*PREDICTION_FIELDS).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_table(rows: DataFrame, path: str, *fields: str) -> None:
    """CSV of the given fields, missing values as empty cells."""
    rows.select(*(fields or rows.columns)).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def write_probe(summary: DataFrame, path: str) -> None:
    """A probe's summary as one CSV in the order of the rates, a few rows."""
    from lectern.operators.stats import PROBE_FIELDS

    summary.orderBy("learning_rate").select(*PROBE_FIELDS).coalesce(1).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def write_gate(results: DataFrame, predictions: dict[str, DataFrame], path: str) -> None:
    """Result rows as JSON, and a predictions table for each tier."""
    results.write.mode("overwrite").json(f"{path}/gate_results")
    for name, rows in predictions.items():
        write_predictions(rows, f"{path}/predictions_{name}")


def write_merged(sources: list[DataFrame], path: str) -> None:
    """The union of several corpora by meeting, into a folder that has to be empty; audio stays where it is."""
    from lectern.operators import checks, corpus

    checks.destination_empty(sources[0].sparkSession, path)
    write_by_meeting(corpus.merge_sources(*sources), path)


def write_json(value, path: str, spark) -> None:
    """A small document, such as settings or a gate's results, as one JSON text."""
    spark.createDataFrame([(json.dumps(value, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_checksums(hashes: DataFrame, path: str) -> None:
    hashes.orderBy("path").select(F.concat_ws("  ", "sha256", "path").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def worksheet(segments: DataFrame) -> DataFrame:
    """(segment_id, html): a review block for each segment, its draft escaped."""
    from lectern.functions.text import html_escape

    block = F.format_string('<section id="%s"><h3>%s</h3><textarea>%s</textarea></section>', html_escape(F.col("segment_id")), html_escape(F.col("segment_id")), html_escape(F.coalesce("text", F.lit(""))))
    return segments.select("segment_id", block.alias("html"))
