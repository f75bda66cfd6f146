"""Residual quantisation of vectors by stacks of codebooks, in Arrow batches.

Codebooks are tables of a model (a few thousand vectors): they are read from files, checked
against a stated size and handed to the tasks. Each level takes the nearest code to what the
levels before left over.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of codebooks at most.
MOST_BYTES = 64 << 20
#: Distances that a task holds at once.
AT_ONCE = 1 << 22

Books = list[np.ndarray]


def books(table: DataFrame) -> Books:
    """The codebooks of table(level, code, vector), a matrix for each level.

    Levels and codes count from 0 without gaps, and all vectors have one length."""
    bytes_ = table.agg(F.sum(F.size("vector") * 8)).first()[0] or 0
    if bytes_ > MOST_BYTES:
        raise ValueError(f"codebooks of {bytes_} bytes; {MOST_BYTES} are allowed")
    found: dict[int, dict[int, list[float]]] = {}
    for r in table.collect():
        if r.code in found.setdefault(r.level, {}):
            raise ValueError(f"level {r.level} has code {r.code} twice")
        found[r.level][r.code] = r.vector
    if sorted(found) != list(range(len(found))) or any(sorted(b) != list(range(len(b))) for b in found.values()):
        raise ValueError("levels and codes must count from 0 without gaps")
    if len({len(v) for b in found.values() for v in b.values()}) > 1:
        raise ValueError("code vectors differ in length")
    return [np.array([found[i][k] for k in range(len(found[i]))], np.float64) for i in range(len(found))]


def scalar_books(levels: int, size: int, seed: int) -> Books:
    """Codebooks of single numbers that follow from the seed, each level finer."""
    rng = np.random.default_rng(seed)
    return [np.sort(rng.normal(0, 6.0 / 4**i, size))[:, None] for i in range(levels)]


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The nearest code of each row, the first of equals. Distances come from one product of
    matrices; rows where its rounding leaves a choice are measured once more directly."""
    out = np.empty(len(x), np.int64)
    norm = (book * book).sum(1)
    step = max(1, AT_ONCE // len(book))
    for lo in range(0, len(x), step):
        part = x[lo : lo + step]
        away = norm - 2 * part @ book.T
        best = away.min(1)
        close = away <= (best + 1e-9 * (norm.max() + (part * part).sum(1) + 1))[:, None]
        code = away.argmin(1)
        for i in np.flatnonzero(close.sum(1) > 1).tolist():
            some = np.flatnonzero(close[i])
            code[i] = some[((part[i] - book[some]) ** 2).sum(1).argmin()]
        out[lo : lo + step] = code
    return out


def quantised(x: np.ndarray, stack: Books) -> tuple[np.ndarray, np.ndarray]:
    """Codes (a column for each level) and what they leave of each row."""
    out, rest = np.empty((len(x), len(stack)), np.int64), x.astype(np.float64)
    for i, book in enumerate(stack):
        out[:, i] = nearest(rest, book)
        rest = rest - book[out[:, i]]
    return out, rest


def codes(vector: Column, stack: Books) -> Column:
    """array<int> of the codes of each level; null for a null vector, one of another length,
    or with a null or non-finite part."""
    dims = stack[0].shape[1]

    @F.pandas_udf("array<int>")
    def run(v: pd.Series) -> pd.Series:
        ok = [x is not None and len(x) == dims for x in v]
        x = np.array([y if good else np.full(dims, np.nan) for y, good in zip(v, ok, strict=True)], np.float64).reshape(len(v), dims)
        good = np.isfinite(x).all(1)
        out = np.empty(len(v), object)
        out[:] = None
        if good.any():
            for i, row in zip(np.flatnonzero(good), quantised(x[good], stack)[0], strict=True):
                out[i] = row
        return pd.Series(out)

    return run(vector)


def scalar_codes(stack: Books) -> Callable[[Column], Column]:
    """Codes of single numbers, on a log scale that keeps the sign."""
    return lambda z: codes(F.when(z.isNotNull(), F.array(F.signum(z) * F.log1p(F.abs(z)))), stack)


def restored(code: Column, stack: Books) -> Column:
    """The sum of the vectors that an array of codes stands for; null where one is missing or
    out of range."""
    dims = stack[0].shape[1]

    @F.pandas_udf("array<double>")
    def run(c: pd.Series) -> pd.Series:
        def one(x):
            if x is None or len(x) != len(stack) or any(k is None or not 0 <= k < len(b) for k, b in zip(x, stack, strict=True)):
                return None
            return sum((b[int(k)] for k, b in zip(x, stack, strict=True)), np.zeros(dims))

        return c.map(one, na_action=None)

    return run(code)
