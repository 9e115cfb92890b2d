"""String similarity that Spark has no built-in for, as Arrow-batched UDFs, and accent folding by built-ins."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher
from functools import cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _lcs(a: str, b: str) -> int:
    """Longest common subsequence length, one machine-word step per character of ``b``."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """0-100: twice the common subsequence over the total length."""
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * _lcs(a, b) / total


@cache
def folding_table() -> dict[str, str]:
    """What NFKD and leaving out all but ASCII make of each character that they don't drop. No character depends on its neighbours:
    NFKD reorders marks only, and those are not ASCII."""
    every = (chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)
    folded = ((c, unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode("ascii")) for c in every)
    return {c: text for c, text in folded if text}


def fold_accents(text):
    """NFKD, then ASCII only (plain built-ins): long expansions are looked up, single characters translated, the rest is dropped."""
    single = {c: t for c, t in folding_table().items() if len(t) == 1}
    longer = {c: t for c, t in folding_table().items() if len(t) > 1}
    one = f"[{''.join(longer)}]"
    expansions = F.str_to_map(F.lit("\x02".join(f"{c}\x01{t}" for c, t in longer.items())), F.lit("\x02"), F.lit("\x01"))
    pieces = F.split(text, f"(?<={one})|(?={one})")
    spelled = F.array_join(F.transform(pieces, lambda p: F.coalesce(F.when(F.length(p) == 1, F.try_element_at(expansions, p)), p)), "")
    spelled = F.when(text.rlike(one), spelled).otherwise(text)
    plain = F.regexp_replace(F.translate(spelled, "".join(single), "".join(single.values())), r"[^\x00-\x7F]", "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), plain).otherwise(text)


@F.pandas_udf(DoubleType())
def sorted_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Indel ratio of two texts whose tokens are already sorted."""
    return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def _common(a: str, b: str) -> int:
    """Characters in common blocks: the longest one (the earliest in ``a``, then in ``b``), and so on left and right of it."""
    start = size = 0
    for i in range(len(a)):
        while i + size < len(a) and a[i:i + size + 1] in b:
            start, size = i, size + 1
    if not size:
        return 0
    at = b.index(a[start:start + size])
    left = _common(a[:start], b[:at]) if start and at else 0
    return left + size + _common(a[start + size:], b[at + size:])


def gestalt_ratio(a: str, b: str) -> float:
    """What ``SequenceMatcher(None, a, b).ratio()`` gives. From 200 characters on that leaves out frequent ones, so it is asked itself."""
    if len(b) >= 200:
        return SequenceMatcher(None, a, b).ratio()
    return 2.0 * _common(a, b) / (len(a) + len(b)) if a or b else 1.0


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio, 0-1."""
    return pd.Series(
        [None if x is None or y is None else gestalt_ratio(x, y) for x, y in zip(a, b)],
        dtype="float64",
    )


def sorted_tokens(text):
    """Tokens in order, joined by one blank (plain built-ins)."""
    tokens = F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")
    return F.array_join(F.array_sort(tokens), " ")


def token_sort_ratio(a, b):
    return sorted_ratio(sorted_tokens(a), sorted_tokens(b))
