"""All pairs within a group, without a task that holds the whole group.

A group of up to ``size`` members is one task. The members of a larger one are
dealt to b blocks by a digest; a member goes to the b tasks that hold its block
and one other, or its block alone. Tasks return counts and one link to a root
for each member, so what leaves them grows with the members, not the pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deal(members: DataFrame, key: list[str], node: str, sizes: DataFrame, size: int) -> DataFrame:
    """``members`` once for each task that needs them, with ``_i`` and ``_j``,
    the task's blocks, and ``_b``, the member's own; ``sizes`` has ``key`` and
    the group's ``members`` count."""
    count = F.ceil(F.col("members") / F.lit(size)).cast("int")
    out = members.join(sizes, key).withColumn("_n", count).withColumn("_b", F.pmod(F.xxhash64(F.lit("block"), node), F.col("_n")).cast("int"))
    other: Column = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    out = out.select("*", other.alias("_o"))
    return out.withColumn("_i", F.least("_b", "_o")).withColumn("_j", F.greatest("_b", "_o")).drop("_n", "_o", "members")


class Labels:
    """Which of ``n`` members are tied together: ``of[k]`` is the least member
    that is tied to k. A task has few members and many pairs, so ties are made
    by arrays, one member with many at a time."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def tie(self, a: int, others: np.ndarray) -> list[tuple[int, int]]:
        """Ties ``a`` to ``others``; returns, for each set of tied members that
        joins another, its least member and that of both."""
        out = []
        mine = self.of[others]
        for label in np.unique(mine[mine != self.of[a]]).tolist():
            low, high = sorted((label, int(self.of[a])))
            self.of[self.of == high] = low
            out.append((high, low))
        return out


def roots(n: int, pairs: list[tuple[int, int]]) -> list[int]:
    """For each of ``n`` members, the least member it is tied to by ``pairs``."""
    up = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]
