"""Inference of a measurement's value ids with trained weights: encoder, shortlist, codes.

Weights are a table (name, row, values) of a few megabytes, read once, checked against a stated
size and handed to the tasks; batches go through numpy. Nothing is trained here.

    var_emb (variables x e); enc_in, film, hidden, mu: a matrix row an output, and <name>_bias
    query (d x d, optional); book_0, book_1, ...: a row a code
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quantise

_AT = np.linspace(-6.0, 6.0, 12 * 1024 + 1)
_ERF = np.array([math.erf(x) for x in _AT.tolist()])
_SLOPE = 2 / math.sqrt(math.pi) * np.exp(-_AT * _AT)


def erf(x: np.ndarray) -> np.ndarray:
    """The error function, by cubic pieces through its values and slopes (to 1e-13)."""
    y = np.clip(x, -6.0, 6.0)
    i = np.clip(((y + 6.0) * 1024).astype(np.int64), 0, len(_AT) - 2)
    t, h = (y - _AT[i]) * 1024, 1 / 1024
    a, b, c, d = _ERF[i], _SLOPE[i] * h, _ERF[i + 1], _SLOPE[i + 1] * h
    return a + t * (b + t * (3 * (c - a) - 2 * b - d + t * (2 * (a - c) + b + d)))


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + erf(x / math.sqrt(2)))


class Model(NamedTuple):
    var_emb: np.ndarray
    enc_in: tuple[np.ndarray, np.ndarray]
    film: tuple[np.ndarray, np.ndarray]
    hidden: tuple[np.ndarray, np.ndarray]
    mu: tuple[np.ndarray, np.ndarray]
    query: np.ndarray | None
    books: quantise.Books


def loaded(weights: DataFrame) -> Model:
    """The model of weights(name, row, values)."""
    size = weights.agg(F.sum(F.size("values") * 8)).first()[0] or 0
    if size > quantise.MOST_BYTES:
        raise ValueError(f"weights of {size} bytes; {quantise.MOST_BYTES} are allowed")
    rows: dict[str, dict[int, list[float]]] = {}
    for r in weights.collect():
        rows.setdefault(r.name, {})[r.row] = r["values"]
    part = {k: np.array([v[i] for i in range(len(v))], np.float64) for k, v in rows.items()}
    layer = lambda k: (part[k], part[f"{k}_bias"][0])
    books = [part[f"book_{i}"] for i in range(sum(k.startswith("book_") for k in part))]
    return Model(part["var_emb"], layer("enc_in"), layer("film"), layer("hidden"), layer("mu"), part.get("query"), books)


def encoded(model: Model, value: np.ndarray, var_id: np.ndarray, context: np.ndarray) -> np.ndarray:
    """The latent vector of each standardised value: an input layer over the value and its
    context, scaled and shifted by the variable's embedding, and two layers."""
    linear = lambda x, w: x @ w[0].T + w[1]
    e = model.var_emb[var_id]
    h = linear(np.column_stack([value, context]), model.enc_in)
    gamma, beta = np.split(linear(e, model.film), 2, axis=1)
    h = gelu(h * (1 + np.tanh(gamma)) + beta)
    return linear(gelu(linear(h, model.hidden)), model.mu)


def shortlist(model: Model, z: np.ndarray, k: int, temperature: float) -> list[np.ndarray]:
    """Of each level the k codes with the highest scores (first of equals first); a level's
    softly weighted codes are taken off before the next."""
    rest, out = z, []
    for book in model.books:
        q = rest if model.query is None else rest @ model.query.T
        score = q @ book.T / math.sqrt(book.shape[1])
        top = np.argsort(-score, axis=1, kind="stable")[:, : max(1, min(k, len(book)))]
        s = np.take_along_axis(score, top, 1) / (temperature + 1e-8)
        w = np.exp(s - s.max(1, keepdims=True))
        w /= w.sum(1, keepdims=True)
        rest = rest - (book[top] * w[:, :, None]).sum(1)
        out.append(top)
    return out


def restricted(books: quantise.Books, z: np.ndarray, tops: list[np.ndarray]) -> np.ndarray:
    """The nearest of each level's shortlist to what the levels before left over."""
    rest, out = z, np.empty((len(z), len(books)), np.int64)
    for i, (book, top) in enumerate(zip(books, tops, strict=True)):
        away = ((rest[:, None] - book[top]) ** 2).sum(2)
        out[:, i] = top[np.arange(len(z)), away.argmin(1)]
        rest = rest - book[out[:, i]]
    return out


def codes(model: Model, value: Column, var_id: Column, *context: Column, k: int | None = 8, temperature: float = 0.5) -> Column:
    """array<int> of the codes of each level of a standardised value of a variable, with
    context inputs in the model's order (time since its last value, age, sex: see ``numeric``).
    k None: without a shortlist. Null for a null or non-finite value, or a variable that the
    model lacks; null context counts as 0."""
    n = len(model.var_emb)

    @F.pandas_udf("array<int>")
    def run(v: pd.Series, var: pd.Series, *more: pd.Series) -> pd.Series:
        x, at = v.to_numpy(np.float64, na_value=np.nan), var.to_numpy(np.float64, na_value=-1)
        ok = np.isfinite(x) & (at >= 0) & (at < n)
        out = np.empty(len(v), object)
        out[:] = None
        if ok.any():
            extra = np.column_stack([m.to_numpy(np.float64, na_value=0.0)[ok] for m in more]) if more else np.zeros((int(ok.sum()), 0))
            z = encoded(model, x[ok], at[ok].astype(np.int64), extra)
            made = quantise.quantised(z, model.books)[0] if k is None else restricted(model.books, z, shortlist(model, z, k, temperature))
            for i, row in zip(np.flatnonzero(ok), made, strict=True):
                out[i] = row
        return pd.Series(out)

    return run(value, var_id, *context)
