"""Scoring streams with trained models: transforms have no state, so they apply to streaming DataFrames as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from grovemill.plans.model import BoostedTrees, RandomForest


def score_stream(model: BoostedTrees | RandomForest, stream: DataFrame) -> DataFrame:
    if not stream.isStreaming:
        raise ValueError("not a stream; use transform")
    return model.transform(stream)


def score_files(model: BoostedTrees | RandomForest, stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Scores what there is and appends it as Parquet; called again, goes on after what was done."""
    return score_stream(model, stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
