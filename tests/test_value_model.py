"""Value inference against a plain reading, value by value."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from caretrail.operators import value_model as V

N_VARS, E, H, D, K = 7, 5, 6, 4, 9


@pytest.fixture(scope="module")
def weights():
    rng = np.random.default_rng(3)
    shapes = {"var_emb": (N_VARS, E), "enc_in": (H, 4), "enc_in_bias": (1, H), "film": (2 * H, E), "film_bias": (1, 2 * H), "hidden": (H, H), "hidden_bias": (1, H), "mu": (D, H), "mu_bias": (1, D), "query": (D, D), "book_0": (K, D), "book_1": (K, D)}
    return {k: rng.normal(size=s) for k, s in shapes.items()}


def one(w, v, var, context, k, temperature=0.5):
    gelu = lambda x: 0.5 * x * (1 + math.erf(x / math.sqrt(2)))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    layer = lambda name, x: [dot(r, x) + b for r, b in zip(w[name], w[f"{name}_bias"][0], strict=True)]
    f = layer("film", w["var_emb"][var])
    h = [gelu(x * (1 + math.tanh(f[i])) + f[H + i]) for i, x in enumerate(layer("enc_in", [v, *context]))]
    z = layer("mu", [gelu(x) for x in layer("hidden", h)])
    soft, hard, out = list(z), list(z), []
    for name in ("book_0", "book_1"):
        book = w[name]
        if k is None:
            top = range(K)
        else:
            score = [dot([dot(r, soft) for r in w["query"]], b) / math.sqrt(D) for b in book]
            top = sorted(range(K), key=lambda i: -score[i])[:k]
            weight = [math.exp(score[i] / (temperature + 1e-8)) for i in top]
            soft = [s - sum(book[i][j] * x for i, x in zip(top, weight)) / sum(weight) for j, s in enumerate(soft)]
        best = min(top, key=lambda i: sum((a - b) ** 2 for a, b in zip(hard, book[i])))
        out.append(best)
        hard = [a - b for a, b in zip(hard, book[best])]
    return out


@pytest.mark.parametrize("k", [1, 3, None])
def test_codes_like_plain(spark, weights, k):
    table = spark.createDataFrame([(n, i, r.tolist()) for n, m in weights.items() for i, r in enumerate(m)], "name string, row int, values array<double>")
    rng = np.random.default_rng(4)
    rows = [(i, float(rng.normal()), int(rng.integers(0, N_VARS)), float(rng.random()), float(rng.random()), float(rng.integers(0, 2))) for i in range(80)]
    odd = [(100, None, 1, 0.0, 0.0, 0.0), (101, float("nan"), 1, 0.0, 0.0, 0.0), (102, 1.0, N_VARS, 0.0, 0.0, 0.0), (103, 1.0, None, 0.0, 0.0, 0.0), (104, 0.5, 2, None, None, None)]
    df = spark.createDataFrame(rows + odd, "i int, v double, var int, dt double, age double, sex double").repartition(3)
    got = {r.i: r.c for r in df.withColumn("c", V.codes(V.loaded(table), F.col("v"), F.col("var"), F.col("dt"), F.col("age"), F.col("sex"), k=k)).collect()}
    for i, v, var, *context in rows:
        assert got[i] == one(weights, v, var, context, k), i
    assert [got[i] for i in (100, 101, 102, 103)] == [None] * 4 and got[104] == one(weights, 0.5, 2, [0.0, 0.0, 0.0], k)


def test_error_function():
    x = np.r_[np.linspace(-8, 8, 4001), 0.0, 1e-12]
    assert np.abs(V.erf(x) - [math.erf(y) for y in x]).max() < 1e-12
