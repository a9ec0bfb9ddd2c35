"""Edit distances of many pairs at once: Hyyrö's bit vectors, the patterns that meet one text end to end in one number."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = re.compile(r"[ \t\n\r\f\x0b]+")


def words_of(text: str) -> list[str]:
    return [w for w in _SPACE.split(text) if w]


class _Patterns:
    """Patterns end to end with a bit between them, which stops carries, and where each part stands in them."""

    def __init__(self, patterns: Sequence[Sequence]) -> None:
        masks: dict = defaultdict(list)
        self.spans, at = [], 0
        for x in patterns:
            for i, part in enumerate(x, at):
                masks[part].append(i)
            self.spans.append((at, (1 << len(x)) - 1))
            at += len(x) + 1
        row = bytearray(at // 8 + 1)
        self.full = self._number(row, (i for places in masks.values() for i in places))
        self.masks = {part: self._number(row, places) for part, places in masks.items()}
        self.first = self.full & self._number(row, (start for start, _ in self.spans))

    @staticmethod
    def _number(row: bytearray, places: Iterable[int]) -> int:
        bits = bytearray(len(row))
        for i in places:
            bits[i >> 3] |= 1 << (i & 7)
        return int.from_bytes(bits, "little")

    def distances(self, text: Sequence) -> list[int]:
        full, first, get = self.full, self.first, self.masks.get
        pv, mv = full, 0
        for part in text:
            eq = get(part, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = ((mv | (full ^ ((xh | pv) & full))) << 1) | first
            pv = (((pv & xh) << 1) & full) | (full ^ ((xv | ph) & full))
            mv = ph & xv
        n = len(text)
        return [n + ((pv >> at) & own).bit_count() - ((mv >> at) & own).bit_count() for at, own in self.spans]


def edit_distances(patterns: Sequence[str | None], texts: Sequence[str | None], parts: Callable[[str], Sequence] = str) -> list[int]:
    """Levenshtein distance of each pair, by letters or by what `parts` gives. Nulls are empty. Each text is gone through
    once with all its patterns."""
    met: dict[str, dict[str, None]] = {}
    for p, t in zip(patterns, texts, strict=True):
        met.setdefault(t or "", {})[p or ""] = None
    made: dict[tuple, _Patterns] = {}
    out = {}
    for t, some in met.items():
        key = tuple(some)
        if key not in made:
            made[key] = _Patterns([parts(p) for p in key])
        out[t] = dict(zip(key, made[key].distances(parts(t)), strict=True))
    return [out[t or ""][p or ""] for p, t in zip(patterns, texts, strict=True)]


def spaced(text: str) -> str:
    """Words with one space between them."""
    return " ".join(words_of(text))


def rate(pattern: Column, text: Column, parts: Callable[[str], Sequence] = str) -> Column:
    """Levenshtein distance of two texts over the pattern's length, which is 1 at least. Nulls are empty."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        size = {p: max(1, len(parts(p or ""))) for p in set(x)}
        return pd.Series([d / size[p] for d, p in zip(edit_distances(x.tolist(), y.tolist(), parts), x, strict=True)], dtype=float)

    return F.pandas_udf(run, "double")(pattern, text)
