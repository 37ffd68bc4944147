"""Comparisons that a request may name."""

from __future__ import annotations

import operator
from collections.abc import Callable

from pyspark.sql import Column

COMPARE: dict[str, Callable] = {">=": operator.ge, ">": operator.gt, "<=": operator.le, "<": operator.lt, "==": operator.eq, "=": operator.eq, "!=": operator.ne}


def compare(value: Column, op: str, threshold: float) -> Column:
    """``value op threshold``, op from a fixed list and nothing else."""
    if op not in COMPARE:
        raise ValueError(f"no comparison {op!r}; one of {', '.join(COMPARE)}")
    return COMPARE[op](value, threshold)
