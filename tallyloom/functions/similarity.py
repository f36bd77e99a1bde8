"""String similarity that Spark lacks, as Arrow-batched functions: Indel ratio on sorted tokens and token sets, matching blocks, longest common run."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit per position of a."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """200 LCS / (|a| + |b|); 100 for two empty texts."""
    return 100.0 if not a and not b else 200.0 * lcs_length(a, b) / (len(a) + len(b))


def token_sort(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """The best of: shared words against shared plus either rest, and both of these against each other."""
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    if not x or not y:
        return 0.0
    if both and (x <= y or y <= x):
        return 100.0
    p, q = (" ".join(z for z in (both, " ".join(sorted(s))) if z) for s in (x - y, y - x))
    return max(indel_ratio(both, p) if both else 0.0, indel_ratio(both, q) if both else 0.0, indel_ratio(p, q))


def longest_run(a: str, b: str) -> int:
    """Longest run of words that both texts have."""
    x, y = a.split(), b.split()
    best, row = 0, [0] * (len(y) + 1)
    at: dict[str, list[int]] = {}
    for j, w in enumerate(y):
        at.setdefault(w, []).append(j)
    for w in x:
        new = [0] * (len(y) + 1)
        for j in at.get(w, ()):
            new[j + 1] = row[j] + 1
            best = max(best, new[j + 1])
        row = new
    return best


def _pairwise(f, kind: str):  # noqa: ANN001, ANN202
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64" if kind == "double" else "int64")

    return run


def token_sort_ratio(a: Column, b: Column) -> Column:
    return _pairwise(token_sort, "double")(a, b)


def token_set_ratio(a: Column, b: Column) -> Column:
    return _pairwise(token_set, "double")(a, b)


def block_ratio(a: Column, b: Column) -> Column:
    """Matching-block ratio of the standard library."""
    return _pairwise(lambda x, y: SequenceMatcher(None, x, y).ratio(), "double")(a, b)


def common_run(a: Column, b: Column) -> Column:
    return _pairwise(longest_run, "long")(a, b)
