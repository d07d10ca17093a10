"""Ratcliff-Obershelp similarity of many pairs of names at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells of a table of pairs and characters that are worked on together.
CELLS = 1 << 21


def _codes(texts: Sequence[str], empty: int) -> tuple[np.ndarray, np.ndarray]:
    """Characters as numbers, a row a text, filled up with ``empty``; and the lengths."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    out = np.full((len(texts), max(1, int(sizes.max(initial=0)))), empty, dtype=np.int32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.int32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out, sizes


def _matched(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Characters of each pair that are in common blocks: the longest, then those to the left and right of it, and so on."""
    x, nx = _codes(a, -1)
    y, ny = _codes(b, -2)
    out = np.zeros(len(a), dtype=np.int64)
    # Ranges still to search: pair, and bounds in both texts.
    zero = np.zeros(len(a), dtype=np.int64)
    todo = np.stack([np.arange(len(a)), zero, nx, zero, ny])
    columns = np.arange(y.shape[1])
    while True:
        todo = todo[:, (todo[1] < todo[2]) & (todo[3] < todo[4])]
        if not todo.shape[1]:
            return out
        pair, low, high, left, right = todo
        inside = (columns >= left[:, None]) & (columns < right[:, None])
        best, at_x, at_y = (np.zeros(len(pair), dtype=np.int64) for _ in range(3))
        ends = np.zeros((len(pair), y.shape[1] + 1), dtype=np.int32)  # lengths of the blocks that end at each place
        for step in range(int((high - low).max())):
            i = np.minimum(low + step, x.shape[1] - 1)
            same = (x[pair, i][:, None] == y[pair]) & inside & (low + step < high)[:, None]
            ends[:, 1:] = np.where(same, ends[:, :-1] + 1, 0)
            most = ends.max(axis=1)
            longer = most > best  # so the first of equally long blocks stays
            best[longer] = most[longer]
            at_x[longer] = (low + step + 1)[longer] - most[longer]
            at_y[longer] = ends.argmax(axis=1)[longer] - most[longer]
        np.add.at(out, pair, best)
        hit = best > 0
        pair, low, high, left, right, best, at_x, at_y = (v[hit] for v in (pair, low, high, left, right, best, at_x, at_y))
        todo = np.concatenate([np.stack([pair, low, at_x, left, at_y]), np.stack([pair, at_x + best, high, at_y + best, right])], axis=1)


def ratios(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """2 * matched characters / all characters of each pair, 1 for two empty texts. All characters count, however often they occur."""
    out = np.ones(len(a))
    order = sorted(range(len(a)), key=lambda i: len(b[i]))  # rows of a table are of like length
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end - at + 1) * (len(b[order[end]]) + 1) <= CELLS and end - at < 4096:
            end += 1
        some = order[at:end]
        sizes = np.array([len(a[i]) + len(b[i]) for i in some])
        found = _matched([a[i] for i in some], [b[i] for i in some])
        out[some] = np.where(sizes > 0, 2.0 * found / np.maximum(sizes, 1), 1.0)
        at = end
    return out


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """``ratios`` as a function of two columns, in Arrow batches; no built-in function has it."""
    return pd.Series(ratios(a.tolist(), b.tolist()), dtype=float)
