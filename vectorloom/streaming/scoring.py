"""Prediction is stateless, so the batch operator runs unchanged on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from vectorloom.plans.model import HDModel


def score_stream(rows: DataFrame, model: HDModel, similarity: bool = False) -> DataFrame:
    """Add ``guess`` to a streaming DataFrame with ``features``."""
    if not rows.isStreaming:
        raise ValueError("rows is not a stream; use HDModel.transform")
    return model.transform(rows, similarity)
