"""vectorloom: hyperdimensional classification and feature selection as Spark jobs."""

from vectorloom.item_memory import ItemMemory, item_memory
from vectorloom.plans.evaluate import cross_validate, evaluate_models, holdout
from vectorloom.plans.model import HDClassifier, HDModel
from vectorloom.plans.selection import (
    backward_elimination,
    feature_importance,
    select_in_chunks,
)

__all__ = [
    "HDClassifier",
    "HDModel",
    "ItemMemory",
    "backward_elimination",
    "cross_validate",
    "evaluate_models",
    "feature_importance",
    "holdout",
    "item_memory",
    "select_in_chunks",
]
