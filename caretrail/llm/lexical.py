"""Ranked lexical search by block-max pruning.

The index cuts the documents, as they lie, into ranges of up to ``BLOCK_DOCS`` (blocks).
A block's row holds its documents' forward index (term numbers and frequencies, document
by document) and, for each of its terms, the number of its documents that hold it and the
highest score part that one of them gives it. Nothing is shuffled to build it.

A search bounds every block for every query from the maxima alone, scores the most
promising blocks of each query first, which sets a threshold that the best documents
reach, and then each task takes its blocks in the order of their bounds and stops at the
first one below the threshold, which rises with what the task finds. Pruned blocks hold no
document of the result, so results are exact.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import base
from .base import WORD_CHAR, Words, saved

BLOCK_DOCS = 64
#: Query text that is searched for, and held by the driver, at once.
QUERY_BYTES = 8 << 20
#: Bounds that a task holds at once.
BOUNDS = 1 << 21
#: Blocks of each query that are scored to set its first threshold.
PROBES = 3
_NULL_ID = -(1 << 63)

_BLOCK = "block long, doc_ids binary, edges binary, numbers binary, counts binary, terms binary, holders binary, peaks binary"


class Index(NamedTuple):
    blocks: DataFrame
    documents: int
    occurrences: int


def _sums(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms with repeats."""

    def run(batches):
        n, total = 0, 0
        for batch in batches:
            for _, data, bounds in base.pieces(batch.column(0)):
                size = np.diff(Words(data, bounds, WORD_CHAR, lower=True, hashed=False).first)
                n, total = n + int((size > 0).sum()), total + int(size.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["n", "l"])

    r = docs.select(F.col("text").cast("string")).mapInArrow(run, "n long, l long").agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    return r.n or 0, r.l or 0


def parts(tf: np.ndarray, size: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a term adds to a document's score, by its weight: in whole numbers, from its
    occurrences, the document's terms, the number of documents and all their terms."""
    if not len(tf):
        return np.zeros(0, np.int64)
    if 75 * int(size.max()) * n >= 1 << 63:
        m = np.array([25 + 75 * x * n // total for x in size.tolist()], np.int64)
    else:
        m = 25 + 75 * size * n // total
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def build_index(docs: DataFrame) -> Index:
    """The index of docs(doc_id, text), saved. Terms are runs of letters, digits and
    non-ASCII characters, A-Z in lower case; documents without any can't be found. A null
    doc_id is kept as the least long."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n, total = _sums(docs)

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at, data, bounds in base.pieces(batch.column(1)):
                words = Words(data, bounds, WORD_CHAR, lower=True)
                ids = batch.column(0).slice(at, words.n)
                size = np.diff(words.first)
                keep = np.flatnonzero(size)
                ids = ids.fill_null(_NULL_ID).to_numpy()[keep]
                for lo in range(0, len(keep), BLOCK_DOCS):
                    some = keep[lo : lo + BLOCK_DOCS]
                    begin, end = words.first[some], words.first[some + 1]
                    doc = np.repeat(np.arange(len(some)), end - begin)
                    terms, number = np.unique(np.concatenate([words.hash[a:b] for a, b in zip(begin, end, strict=True)]), return_inverse=True)
                    cell, tf = np.unique(doc * len(terms) + number, return_counts=True)
                    doc, number = cell // len(terms), cell % len(terms)
                    peaks = np.zeros(len(terms), np.int64)
                    np.maximum.at(peaks, number, parts(tf, size[some][doc], n, total))
                    edges = np.searchsorted(doc, np.arange(len(some) + 1))
                    # documents keep their own number of terms as the last count of all
                    counts = np.concatenate([tf, size[some]])
                    holders = np.bincount(number, minlength=len(terms))
                    kept = (ids[lo : lo + BLOCK_DOCS].astype(np.int64), edges.astype(np.int32), number.astype(np.int32), counts.astype(np.int32), terms, holders.astype(np.int32), peaks.astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in kept)], names=[x.split()[0] for x in _BLOCK.split(", ")])
                    block += 1

    return Index(saved(docs.mapInArrow(run, _BLOCK), "blocks"), n, total)


class _Queries:
    """Queries of a block: their distinct terms, and each one's terms with weights."""

    def __init__(self, texts: list[str]):
        raw = [t.encode() for t in texts]
        words = Words(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64), WORD_CHAR, lower=True)
        self.terms, number = np.unique(words.hash, return_inverse=True)
        query = np.repeat(np.arange(len(texts)), np.diff(words.first))
        cell, self.repeats = np.unique(query * max(len(self.terms), 1) + number, return_counts=True)
        self.number = cell % max(len(self.terms), 1)
        #: first[q]:first[q + 1] are the terms of query q.
        self.first = np.searchsorted(cell // max(len(self.terms), 1), np.arange(len(texts) + 1))
        self.weight = np.zeros(0, np.int64)

    def weigh(self, holders: np.ndarray, n: int) -> None:
        by_term = np.array([math.floor(1000 * math.log(float(2 * n + 2) / float(2 * df + 1))) for df in holders.tolist()], np.int64)
        self.weight = by_term[self.number] * self.repeats

    def among(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each distinct term whether it is there, and where."""
        at = np.minimum(np.searchsorted(terms, self.terms), max(len(terms) - 1, 0))
        return terms[at] == self.terms, at

    def bounds(self, there: np.ndarray, at: np.ndarray, peaks: np.ndarray) -> np.ndarray:
        """No document of a block scores above this, by query."""
        each = np.where(there, peaks[at], 0).astype(np.int64)[self.number] * self.weight
        sums = np.r_[0, np.cumsum(each)]
        return sums[self.first[1:]] - sums[self.first[:-1]]


class _Block:
    """A block's forward index, with the score parts of its cells."""

    def __init__(self, row: tuple[bytes, ...], n: int, total: int):
        ids, edges, numbers, counts, terms = row
        self.ids, self.edges = np.frombuffer(ids, np.int64), np.frombuffer(edges, np.int32)
        self.numbers, self.terms = np.frombuffer(numbers, np.int32), np.frombuffer(terms, np.uint64)
        counts = np.frombuffer(counts, np.int32).astype(np.int64)
        size = np.repeat(counts[len(self.numbers) :], np.diff(self.edges))
        self.parts = parts(counts[: len(self.numbers)], size, n, total)

    def scores(self, queries: _Queries, q: int, there: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The score of every document for query q."""
        own = slice(queries.first[q], queries.first[q + 1])
        held = there[queries.number[own]]
        weight = np.zeros(len(self.terms), np.int64)
        weight[at[queries.number[own]][held]] = queries.weight[own][held]
        return np.add.reduceat(weight[self.numbers] * self.parts, self.edges[:-1])


def _best(ids: np.ndarray, score: np.ndarray, k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows with a score of at least ``least``, ties to smaller ids."""
    ok = np.flatnonzero(score >= least)
    if len(ok) > k:
        cut = -np.partition(-score[ok], k - 1)[k - 1]
        ok = ok[score[ok] >= cut]
    ok = ok[np.lexsort((ids[ok], -score[ok]))[:k]]
    return ids[ok], score[ok]


def _rows(batch: pa.RecordBatch) -> list[tuple]:
    return list(zip(*(c.to_pylist() for c in batch.columns), strict=True))


def _at_once(queries: int) -> int:
    """Blocks that are bounded at once."""
    return max(16, BOUNDS // max(queries, 1))


_FORWARD = ("doc_ids", "edges", "numbers", "counts", "terms")


def _holders(index: Index, queries: _Queries) -> np.ndarray:
    """Of each distinct term of the queries the documents that hold it."""

    def run(batches):
        sums = np.zeros(len(queries.terms), np.int64)
        for batch in batches:
            for terms, holders in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                there, at = queries.among(np.frombuffer(terms, np.uint64))
                sums += np.where(there, np.frombuffer(holders, np.int32)[at], 0)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(sums[some], pa.int64())], names=["term", "n"])

    out = np.zeros(len(queries.terms), np.int64)
    for r in index.blocks.select("terms", "holders").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r.term] = r.n
    return out


def _promising(index: Index, queries: _Queries, k: int) -> dict[int, list[int]]:
    """Of each query the PROBES blocks with the highest bounds: queries by block."""
    n = len(queries.first) - 1

    def run(batches):
        bound, block = np.zeros((PROBES, n), np.int64), np.zeros((PROBES, n), np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, _at_once(n)):
                rows = _rows(batch.slice(i, _at_once(n)))
                here = np.array([queries.bounds(*queries.among(np.frombuffer(t, np.uint64)), np.frombuffer(p, np.int32)) for _, t, p in rows])
                bound = np.vstack([bound, here])
                block = np.vstack([block, np.repeat(np.array([[r[0]] for r in rows]), n, axis=1)])
                top = np.argsort(-bound, axis=0, kind="stable")[:PROBES]
                bound, block = np.take_along_axis(bound, top, 0), np.take_along_axis(block, top, 0)
        _, q = np.nonzero(bound)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(block[bound > 0]), pa.array(bound[bound > 0])], names=["q", "block", "bound"])

    made = index.blocks.select("block", "terms", "peaks").mapInArrow(run, "q long, block long, bound long")
    top = made.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("bound"), "block"))).where(F.col("r") <= PROBES)
    found: dict[int, list[int]] = {}
    for r in top.collect():  # PROBES rows a query at most
        found.setdefault(r.block, []).append(r.q)
    return found


def _thresholds(index: Index, queries: _Queries, k: int) -> np.ndarray:
    """A score that k documents of each query reach (1 where fewer are known)."""
    n, total = index.documents, index.occurrences
    chosen = _promising(index, queries, k)

    def run(batches):
        for batch in batches:
            for block, *row in _rows(batch):
                b = _Block(tuple(row), n, total)
                there, at = queries.among(b.terms)
                for q in chosen[block]:
                    _, score = _best(b.ids, b.scores(queries, q, there, at), k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), q), pa.int64()), pa.array(score)], names=["q", "score"])

    out = np.ones(len(queries.first) - 1, np.int64)
    some = index.blocks.where(F.col("block").isin(list(chosen))).select("block", *_FORWARD) if chosen else index.blocks.limit(0).select("block", *_FORWARD)
    kth = some.mapInArrow(run, "q long, score long").withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score")))).where(F.col("r") == k)
    for r in kth.collect():  # a row a query
        out[r.q] = r.score
    return out


def _search(index: Index, queries: _Queries, k: int) -> DataFrame:
    """(q, doc_id, score): each task's best documents, the result's among them."""
    n, total = index.documents, index.occurrences
    first = _thresholds(index, queries, k)

    def visit(rows, threshold, best):
        met = [queries.among(np.frombuffer(r[4], np.uint64)) for r in rows]
        bound = np.array([queries.bounds(*m, np.frombuffer(r[5], np.int32)) for m, r in zip(met, rows, strict=True)])
        blocks: dict[int, _Block] = {}
        for q in np.flatnonzero((bound >= threshold).any(axis=0)).tolist():
            for i in np.argsort(-bound[:, q], kind="stable").tolist():
                if bound[i, q] < threshold[q]:
                    break
                if i not in blocks:
                    blocks[i] = _Block(rows[i][:5], n, total)
                b = blocks[i]
                ids, score = _best(b.ids, b.scores(queries, q, *met[i]), k, int(threshold[q]))
                if not len(ids):
                    continue
                if q in best:
                    ids, score = _best(np.r_[best[q][0], ids], np.r_[best[q][1], score], k)
                best[q] = ids, score
                if len(ids) == k:
                    threshold[q] = max(threshold[q], score[-1])

    def run(batches):
        threshold = first.copy()
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, _at_once(len(first))):
                visit(_rows(batch.slice(i, _at_once(len(first)))), threshold, best)
        for q, (ids, score) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q), pa.int64()), pa.array(ids), pa.array(score)], names=["q", "doc_id", "score"])

    return index.blocks.select(*_FORWARD, "peaks").mapInArrow(run, "q long, doc_id long, score long")


def search(index: Index, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id and score of the k highest-scoring documents of each row of
    items(item_id, text), equal scores by doc_id; only scores above 0 count.

    A term's weight is floor(1000 * ln((2 N + 2) / (2 df + 1))); see ``parts`` for what it
    is multiplied with. Repeated terms of an item count as often. Items are a stated query
    set, searched in blocks of bounded size, each against the whole index. Null and empty
    texts, and terms that no document holds, find nothing; very long items are queries like
    others. Rows that repeat both item_id and text count once; other texts of the same
    item_id (null too) are queries of their own. Documents that repeat a doc_id are each
    ranked, those without one before others of their score. Other columns are not read; an empty index or no items give an empty result.
    """
    spark = items.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    items = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // QUERY_BYTES
    found = None
    for i in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).collect() if index.documents else []
        queries = _Queries([r.text for r in rows])
        if not len(queries.terms):
            continue
        queries.weigh(_holders(index, queries), index.documents)
        near = _search(index, queries, k)
        rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "doc_id"))
        near = near.withColumn("rank", rank).where(F.col("rank") <= k)
        names = spark.createDataFrame([(q, r.item_id) for q, r in enumerate(rows)], f"q long, item_id {kind}")
        part = near.join(F.broadcast(names), "q").select("item_id", "rank", F.when(F.col("doc_id") != _NULL_ID, F.col("doc_id")).alias("doc_id"), "score")  # names: a row a query of the block
        found = part if found is None else found.union(part)
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if found is None else found
