"""Validated run parameters."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Parameters of one classifier run.

    ``retrain_mode`` is ``online`` (row by row, classes change at once) or
    ``batch`` (classes fixed during a pass; a different algorithm that scales
    one model over the whole cluster).
    """

    dimensionality: int = 10000
    levels: int = 2
    seed: int = 0
    retrain: int = 0
    stop: bool = False
    retrain_mode: str = "online"

    def __post_init__(self):
        _at_least("dimensionality", self.dimensionality, 10)
        _at_least("levels", self.levels, 2)
        _at_least("retrain", self.retrain, 0)
        if self.retrain_mode not in ("online", "batch"):
            raise ValueError("retrain_mode must be 'online' or 'batch'")


def _at_least(name: str, value: int, low: int) -> None:
    if int(value) != value or value < low:
        raise ValueError(f"{name} must be a whole number >= {low}, got {value!r}")


def check_percentage(name: str, value: float) -> float:
    if not 0 <= value <= 100:
        raise ValueError(f"{name} must lie between 0 and 100, got {value!r}")
    return float(value)


def check_folds(k: int) -> int:
    _at_least("number of folds", k, 2)
    return int(k)
