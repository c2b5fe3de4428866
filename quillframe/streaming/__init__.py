"""Expressions and models over streams: what needs one row at a time works on a streaming DataFrame as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame


def score_stream(stream: DataFrame, model, name: str = "score") -> DataFrame:
    """A streaming DataFrame with a PMML model's score: no state, no shuffle."""
    return model.score(stream, name)
