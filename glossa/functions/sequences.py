"""Sequence comparison (V13-V16): what no built-in expresses, as Arrow-batched pandas UDFs.

Each takes two columns of token arrays. The longest common subsequence is
computed bit-parallel: one big integer stands for a whole row of the table.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructType


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence."""
    if not len(a) or not len(b):
        return 0
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & where.get(y, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _table(a: list, b: list) -> list[list[int]]:
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    return t


def sdiff(a: list, b: list) -> list[tuple[str, str | None, str | None]]:
    """Steps from a to b: u (same), c (changed), - (only in a), + (only in b)."""
    t, i, j = _table(a, b), 0, 0
    out: list[tuple[str, str | None, str | None]] = []
    minus: list = []
    plus: list = []

    def flush() -> None:
        for k in range(max(len(minus), len(plus))):
            x, y = (minus[k] if k < len(minus) else None), (plus[k] if k < len(plus) else None)
            out.append(("c" if x is not None and y is not None else "-" if y is None else "+", x, y))
        minus.clear()
        plus.clear()

    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            flush()
            out.append(("u", a[i], b[j]))
            i, j = i + 1, j + 1
        elif j >= len(b) or i < len(a) and t[i + 1][j] >= t[i][j + 1]:
            minus.append(a[i])
            i += 1
        else:
            plus.append(b[j])
            j += 1
    flush()
    return out


def operations(a: list[str], b: list[str]) -> list[tuple[str, str, str]]:
    """Substitutions, deletions and insertions; changes of case alone don't count, an absent side is the empty mark."""
    names = {"c": "s", "-": "d", "+": "i"}
    return [(names[k], x or "ε", y or "ε") for k, x, y in sdiff(a, b) if k != "u" and not (k == "c" and x.lower() == y.lower())]


def align(a: list, b: list, match: Callable = lambda x, y: 1.0, insert: Callable = lambda y: 1.0, delete: Callable = lambda x: 1.0) -> dict[int, int]:
    """Least-cost alignment: positions of a to positions of b.

    All three steps cost 1 by default, a match too; deletion goes before
    insertion, and both before a match, where costs tie.
    """
    n, m = len(a), len(b)
    cost = [[0.0] * (m + 1) for _ in range(n + 1)]
    step = [[""] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            ways = []
            if i:
                ways.append((cost[i - 1][j] + delete(a[i - 1]), 0, "d"))
            if j:
                ways.append((cost[i][j - 1] + insert(b[j - 1]), 1, "i"))
            if i and j:
                ways.append((cost[i - 1][j - 1] + match(a[i - 1], b[j - 1]), 2, "m"))
            if ways:
                cost[i][j], _, step[i][j] = min(ways)
    out, i, j = {}, n, m
    while i or j:
        if step[i][j] == "m":
            i, j = i - 1, j - 1
            out[i] = j
        elif step[i][j] == "d":
            i -= 1
        else:
            j -= 1
    return dict(sorted(out.items()))


@F.pandas_udf(IntegerType())
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two arrays."""
    return pd.Series([lcs_length(list(x), list(y)) if x is not None and y is not None else 0 for x, y in zip(a, b, strict=True)])


def lcs_similarity(a, b, over: str = "first"):
    """Longest common subsequence over the first array's length, or with over="max" the longer's."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    n = F.size(a) if over == "first" else F.greatest(F.size(a), F.size(b))
    return F.when(n > 0, lcs(a, b) / n).otherwise(F.lit(0.0))


@F.pandas_udf(ArrayType(StructType().add("op", StringType()).add("from", StringType()).add("to", StringType())))
def diff_operations(a: pd.Series, b: pd.Series) -> pd.Series:
    """operations() of two arrays."""
    return pd.Series([[{"op": o, "from": x, "to": y} for o, x, y in operations(list(p), list(q))] if p is not None and q is not None else [] for p, q in zip(a, b, strict=True)])


@F.pandas_udf(MapType(IntegerType(), IntegerType()))
def alignment(a: pd.Series, b: pd.Series) -> pd.Series:
    """align() of two arrays with the default costs."""
    return pd.Series([align(list(p), list(q)) if p is not None and q is not None else {} for p, q in zip(a, b, strict=True)])
