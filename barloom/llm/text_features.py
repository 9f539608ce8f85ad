"""Numbers that describe a whole text, each within about [0, 1], for classifiers.

An Arrow-batched function: interpreted higher-order functions over millions of words cost several times
as much as Python's own string functions. Words are runs of anything but the six ASCII space characters.
A null text is an empty one and has zeros. Memory is a small multiple of an Arrow batch.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.llm.quality_rules import STOP_WORDS, SYMBOLS, WINDOW
from barloom.llm.ship import by_value

by_value(__name__)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
STOPS, SIGNS, SPAN = frozenset(STOP_WORDS), tuple(SYMBOLS), WINDOW
MIX = 0x9E3779B97F4A7C15


def repeated_words(words: list[str], window: int = SPAN) -> int:
    """Words in windows of ``window`` words, a power of two, that occur twice or more."""
    n = len(words)
    if n <= window:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    step, factor = 1, MIX
    while step < window:
        hashes = hashes[:-step] * np.uint64(factor) + hashes[step:]
        step, factor = 2 * step, factor * factor % 2**64
    by_hash = np.argsort(hashes, kind="stable")
    ordered = hashes[by_hash]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    starts = by_hash[np.append(same, False) | np.append(False, same)]
    edges = np.zeros(n + 1, np.int64)
    edges[starts] += 1
    edges[starts + window] -= 1
    return int((np.cumsum(edges) > 0).sum())


def describe(text: str | None) -> list[float]:
    text = text or ""
    words = WORD.findall(text)
    n = max(1, len(words))
    lines = [line for line in text.split("\n") if line.strip(" \t\x0b\x0c\r")]
    weight = min(1.0, n / 40)  # shares of short texts say little
    share = lambda count: min(1.0, count / n)
    stops = sum(map(STOPS.__contains__, map(str.lower, words)))
    letters = sum(w.lower() != w.upper() for w in words)
    return [
        share(sum(map(text.count, SIGNS))), share(text.count("!")),
        share(sum(w.isupper() and len(w) > 1 for w in words)), share(repeated_words(words)),
        min(1.0, (len(lines) - len(set(lines))) / max(1, len(lines))),
        max(0.0, 0.15 - share(stops)) / 0.15 * weight,
        (1 - share(letters)) * weight if words else 0.0,
        min(1.0, abs(sum(map(len, words)) / n - 5.5) / 10) * weight if words else 0.0,
        math.log1p(len(words)) / 12,
    ]


def features(text: Column | str) -> Column:
    """The numbers as array<double>."""

    @F.pandas_udf("array<double>")
    def described(texts: pd.Series) -> pd.Series:
        return texts.map(describe)

    return described(text)
