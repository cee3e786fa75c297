"""Folding and edit distance shared by the entity operators."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from leadloom.llm.scripts import plain

# Letters without a Unicode decomposition.
_UNDECOMPOSED = str.maketrans({"đ": "d", "ß": "ss", "ł": "l", "ø": "o", "æ": "ae", "œ": "oe"})
_UMLAUT = re.compile("([aou])e")


def _bare(text: str) -> str:
    text = plain(text).casefold().translate(_UNDECOMPOSED)
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


_bare_cached = lru_cache(maxsize=65_536)(_bare)


def bare(text: str) -> str:
    """Plain spelling, lower case, without accents. Short texts are remembered."""
    return _bare_cached(text) if len(text) <= 200 else _bare(text)


def merge_digraphs(text: str) -> str:
    """Written-out accents: ae, oe, ue and dj of a bare text become a, o, u and d."""
    return _UMLAUT.sub(r"\1", text).replace("dj", "d")


def fold(text: str) -> str:
    """Bare text in which ä, ae and a are one letter (likewise o, u)."""
    return merge_digraphs(bare(text))


def osa_within(a: str, b: str, limit: int) -> int:
    """Optimal string alignment distance (adjacent swaps cost 1) in a band; ``limit + 1`` if above it."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if abs(n - m) > limit:
        return limit + 1
    big = limit + 1
    before: list[int] = []
    row = [j if j <= limit else big for j in range(m + 1)]
    for i in range(1, n + 1):
        lo, hi = max(1, i - limit), min(m, i + limit)
        cur = [big] * (m + 1)
        cur[0] = i if i <= limit else big
        x = a[i - 1]
        best = cur[0]
        for j in range(lo, hi + 1):
            y = b[j - 1]
            v = row[j - 1] + (x != y)
            if row[j] + 1 < v:
                v = row[j] + 1
            if cur[j - 1] + 1 < v:
                v = cur[j - 1] + 1
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and before[j - 2] + 1 < v:
                v = before[j - 2] + 1
            cur[j] = v if v < big else big
            if v < best:
                best = v
        if best > limit:
            return big
        before, row = row, cur
    return min(row[m], big)
