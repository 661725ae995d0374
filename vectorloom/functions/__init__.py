"""Column expressions: vector helpers, level lookup and ordering keys."""

from vectorloom.functions.keys import order_key, run_id
from vectorloom.functions.levels import level_of, levels_of
from vectorloom.functions.vectors import (
    hv_add,
    hv_cosine,
    hv_dot,
    hv_flip,
    hv_norm,
    hv_roll,
    hv_sub,
)

__all__ = [
    "hv_add", "hv_cosine", "hv_dot", "hv_flip", "hv_norm", "hv_roll", "hv_sub",
    "level_of", "levels_of", "order_key", "run_id",
]
