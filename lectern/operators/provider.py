"""Hypotheses from a recogniser that the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def transcribe(segments: DataFrame, load: Callable[[], Callable[[list[str]], list[str]]], batch_size: int = 8, column: str = "audio_filepath") -> DataFrame:
    """segments with `hyp_raw`. `load` runs once in each task and gives a function from a batch of inputs to as many texts, in order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recognise = load()
        for frame in frames:
            inputs, texts = frame[column].tolist(), []
            for low in range(0, len(inputs), batch_size):
                batch = inputs[low : low + batch_size]
                found = recognise(batch)
                if len(found) != len(batch):
                    raise ValueError(f"{len(found)} texts for {len(batch)} inputs")
                texts += found
            yield frame.assign(hyp_raw=texts)

    schema = T.StructType([*segments.schema.fields, T.StructField("hyp_raw", T.StringType())])
    return segments.mapInPandas(run, schema)


def scored(segments: DataFrame, normalizer: Callable, ref: str = "text", hyp: str = "hyp_raw") -> DataFrame:
    """segments with ref and hyp under one normaliser of columns, ready to be counted."""
    from pyspark.sql import functions as F

    return segments.withColumns({"ref": normalizer(F.col(ref)), "hyp": normalizer(F.coalesce(F.col(hyp), F.lit("")))})


def sweep(segments: DataFrame, weights: list[float], transcripts: DataFrame) -> DataFrame:
    """Segments for each weight of a sweep with that weight's transcript; a missing one is empty. transcripts: (lambda, segment_id, hyp_raw)."""
    from pyspark.sql import functions as F

    grid = segments.withColumn("lambda", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    return grid.join(transcripts, ["lambda", "segment_id"], "left").withColumn("hyp_raw", F.coalesce("hyp_raw", F.lit("")))
