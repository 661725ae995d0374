"""Scoring unbounded input with a fitted model."""

from vectorloom.streaming.scoring import score_stream

__all__ = ["score_stream"]
