"""Toxic spans by a linear-chain conditional random field, and document scores.

Tokens are toxic (T) or other (O). Their weights come from hashed features (the word,
and its first four and five bytes) and from transitions. Documents bear labels, tokens
do not; so tokens of labelled toxic documents are labelled T where one of their features
is far commoner in toxic than in clean documents, all others O. The field is fitted to
these by gradient steps on the exact likelihood (forward-backward). Marginals of T are
aggregated to a document's score: a logistic function, fitted to the document labels,
of the highest marginal and of the expected number of toxic tokens.

The fit uses a bounded sample: at most ``sample`` labelled documents of each class and
at most ``sample_chars`` characters each. Scoring reads whole texts of all documents,
in tasks, and moves nothing between them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import WORD_CHAR, Words, pieces

BUCKETS = 1 << 18
PREFIXES = (4, 5)


@dataclass
class Field:
    """weights: of T against O, by feature bucket; step: log weights of transitions,
    step[0, 1] from O to T; both as fitted. final: of the document's logistic function."""

    weights: np.ndarray
    bias: float
    step: np.ndarray
    final: np.ndarray

    def unary(self, features: np.ndarray) -> np.ndarray:
        return np.clip(self.weights[features].sum(axis=1) + self.bias, -30, 30)


def token_features(words: Words) -> np.ndarray:
    cut = [words.hashed(np.minimum(words.ends, words.starts + k)) ^ np.uint64(k) for k in PREFIXES]
    return np.stack([x % np.uint64(BUCKETS) for x in (words.hash, *cut)], axis=1).astype(np.int64)


def marginals(unary: np.ndarray, first: np.ndarray, step: np.ndarray, pairs: bool = False):
    """Probability of T for every token, by forward-backward over each text; with pairs,
    also the expected numbers of the four transitions. Texts of similar length go
    through the recursion together, as columns of one array."""
    size = np.diff(first)
    out = np.zeros(len(unary))
    expected = np.zeros((2, 2))
    (oo, ot), (to, tt) = np.exp(step)
    for power in np.unique(np.log2(size[size > 0]).astype(int)).tolist() if (size > 0).any() else []:
        rows = np.flatnonzero((size >= 1 << power) & (size < 2 << power))
        rows = rows[np.argsort(-size[rows], kind="stable")]
        n, m = int(size[rows[0]]), len(rows)
        at = np.minimum(first[rows], len(unary) - 1) + np.arange(n)[:, None]
        real = np.arange(n)[:, None] < size[rows]
        grid = np.exp(unary[np.minimum(at, len(unary) - 1)])
        live = real.sum(axis=1)
        forward, backward = np.zeros((n, m)), np.ones((n, m))
        forward[0] = now = grid[0]
        for t in range(1, n):  # ratios T : O of the forward sums
            k = live[t]
            now = now[:k]
            now = grid[t, :k] * (ot + now * tt) / (oo + now * to)
            forward[t, :k] = now
        for t in range(n - 2, -1, -1):  # and of the backward sums, 1 at a text's end
            k = live[t + 1]
            now = grid[t + 1, :k] * backward[t + 1, :k]
            backward[t, :k] = (to + now * tt) / (oo + now * ot)
        ratio = forward * backward
        p = ratio / (1 + ratio)
        out[at[real]] = p[real]
        if pairs and n > 1:
            both = real[1:]
            f, g = forward[:-1][both], (grid[1:] * backward[1:])[both]
            four = np.stack([np.full(len(f), oo), ot * g, to * f, tt * f * g])
            expected += (four / four.sum(axis=0)).sum(axis=1).reshape(2, 2)
    return (out, expected) if pairs else out


def summary(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """1, logit of the highest marginal and log of 1 + the expected toxic tokens, by text."""
    out = np.tile([1.0, -12.0, 0.0], (len(first) - 1, 1))
    some = np.flatnonzero(np.diff(first))
    if len(some):
        top = np.clip(np.maximum.reduceat(p, first[some]), 1e-6, 1 - 1e-6)
        out[some, 1] = np.clip(np.log(top / (1 - top)), -12, 12)
        out[some, 2] = np.log1p(np.add.reduceat(np.where(p >= 0.5, p, 0), first[some]))
    return out


def fit(texts: list[str], toxic: list[int], rounds: int = 40) -> Field:
    """Fits the field to a sample of labelled texts."""
    raw = [t.encode() for t in texts]
    bounds = np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64)
    words = Words(np.frombuffer(b"".join(raw), np.uint8), bounds, WORD_CHAR, lower=True)
    features, first, y = token_features(words), words.first, np.array(toxic, bool)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    # distant labels: features that are far commoner in toxic documents, counted by the
    # different neighbours they have, so that copies of a document count once
    beside = np.r_[np.uint64(0), words.hash, np.uint64(0)]
    around = (beside[:-2] * np.uint64(3) ^ beside[2:]).view(np.int64)
    pair = np.unique(np.stack([features.ravel(), np.repeat(around, features.shape[1]), np.repeat(y[doc], features.shape[1])]), axis=1)
    seen = [np.bincount(pair[0][pair[2] == c], minlength=BUCKETS) for c in (0, 1)]
    odds = np.log((seen[1] + 0.5) / (y.sum() + 1)) - np.log((seen[0] + 0.5) / ((~y).sum() + 1))
    marked = (odds >= 3) & (seen[1] >= max(3, 0.012 * y.sum()))
    label = marked[features].any(axis=1) & y[doc]
    # gradient steps (Adam) on the likelihood of the labels
    inner = doc[1:] == doc[:-1]
    observed = np.bincount(2 * label[:-1][inner] + label[1:][inner], minlength=4).reshape(2, 2)
    theta = np.zeros(BUCKETS + 1 + 4)
    theta[BUCKETS] = -3.0
    m, v, scale = np.zeros_like(theta), np.zeros_like(theta), max(1, len(label))
    flat = features.ravel()
    for t in range(1, rounds + 1):
        unary = np.clip(theta[:BUCKETS][features].sum(axis=1) + theta[BUCKETS], -30, 30)
        p, expected = marginals(unary, first, theta[-4:].reshape(2, 2), pairs=True)
        miss = p - label
        grad = np.r_[np.bincount(flat, np.repeat(miss, features.shape[1]), BUCKETS), miss.sum(), (expected - observed).ravel()] / scale * 1e3 + 1e-3 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    field = Field(theta[:BUCKETS].astype(np.float32), float(theta[BUCKETS]), theta[-4:].reshape(2, 2), np.zeros(3))
    x = summary(marginals(field.unary(features), first, field.step), first)
    for _ in range(30):  # Newton steps of the logistic function
        q = 1 / (1 + np.exp(-np.clip(x @ field.final, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(3)
        field.final += np.clip(np.linalg.solve(h, x.T @ (y - q) - 1e-2 * field.final), -2, 2)
    return field


def held_out(key: str = "doc_id") -> F.Column:
    """Whether crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = 1500, sample_chars: int = 6000) -> Field | None:
    """A field fitted to labelled documents that are not held out: of each class the
    ``sample`` with the smallest hashes among texts of up to sample_chars characters.
    None if a class is missing."""
    good = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).select(F.col("doc_id").cast("long"), "toxic")
    rows = []
    for c in (1, 0):  # a few more ids than needed, as longer texts are left out
        ids = good.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample)
        texts = docs.select(F.col("doc_id").cast("long"), "text").where(F.length("text") <= sample_chars)
        got = texts.join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        rows.append(got.select("text", "toxic").collect())
    if not all(rows):
        return None
    both = rows[0] + rows[1]
    return fit([r.text for r in both], [r.toxic for r in both])


def score(docs: DataFrame, field: Field | None, text: str = "text", keep_text: bool = False) -> DataFrame:
    """docs, without text unless keep_text, and score (0 to 1), predicted (1 if score >= 0.5) and spans:
    start, stop, start, stop, ... of runs of tokens with a marginal of 0.5 or more, as
    byte offsets in the UTF-8 text. Without a field, score is 0. Null and empty texts
    have no tokens and get the score of that. Other columns are kept, but for those
    that bear one of the new names."""
    left = [c for c in docs.columns if c not in ("score", "predicted", "spans") and (keep_text or c != text)]
    schema = docs.select(*left).schema.add("score", "double").add("spans", T.ArrayType(T.LongType()))

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for at, data, bounds in pieces(column):
                n = len(bounds) - 1
                spans: list[list[int]] = [[] for _ in range(n)]
                value = np.zeros(n)
                if field:
                    words = Words(data, bounds, WORD_CHAR, lower=True)
                    p = marginals(field.unary(token_features(words)), words.first, field.step)
                    value = 1 / (1 + np.exp(-np.clip(summary(p, words.first) @ field.final, -30, 30)))
                    hot = np.flatnonzero(p >= 0.5)
                    owner = np.searchsorted(words.first, hot, "right") - 1
                    last = None
                    for w, d in zip(hot.tolist(), owner.tolist(), strict=True):
                        if last == (w - 1, d):
                            spans[d][-1] = int(words.ends[w] - bounds[d])
                        else:
                            spans[d] += [int(words.starts[w] - bounds[d]), int(words.ends[w] - bounds[d])]
                        last = w, d
                keep = [batch.column(batch.schema.get_field_index(c)).slice(at, n) for c in left]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(value, pa.float64()), pa.array(spans, pa.list_(pa.int64()))], names=schema.names)

    out = docs.select(*dict.fromkeys([*left, text])).mapInArrow(run, schema)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
