"""Removal of long word passages that an earlier document has too.

A window is ``window`` consecutive words of one document. Hashing every window of the
corpus would move as many keys as there are words. Instead, shorter anchors are hashed
at the positions of a difference cover only: D is a set of residues modulo v such that
every difference modulo v is one between two of its members. So for any two positions
i, j some k < v puts both i + k and j + k on the cover, and equal windows at i and j
share the anchor of window - v + 1 words there, whatever their alignment.

1. Anchors that two documents share are found by ``exchange.meet``.
2. They are extended: of each document, the windows around a shared anchor (those with
   the anchor in the first v places) are hashed; all other windows are unique.
3. ``meet`` finds the windows that a smaller document has; their words go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import NOT_SPACE, Words, dropped, pieces, saved
from .exchange import meet

#: A perfect difference set (fixed values): all of 1..30 are differences modulo 31.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)


def difference_cover(v: int) -> tuple[int, ...]:
    """A cover modulo v, greedily: any v works, fewer residues mean fewer anchors."""
    if v == PERIOD:
        return COVER
    cover, missing = [0], {*range(1, v)}
    while missing:
        gain = lambda x: len(missing & {d for c in cover for d in ((x - c) % v, (c - x) % v)})
        cover.append(best := max(range(v), key=gain))
        missing -= {d for c in cover for d in ((best - c) % v, (c - best) % v)}
    return tuple(sorted(cover))


def _words(column):
    for at, data, bounds in pieces(column):
        yield at, Words(data, bounds, NOT_SPACE, lower=False)


def _marked(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of n places are covered by [start, start + length) of any start."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + length, n), -1)
    return np.cumsum(step[:n]) > 0


def _kept(docs: DataFrame, window: int) -> DataFrame:
    """docs(doc_id, text, starts) without the words of the windows at starts."""

    def run(batches):
        for batch in batches:
            for at, words in _words(batch.column(1)):
                starts = batch.column(2).slice(at, words.n).to_pylist()
                n, gone, text, spans = [], [], [], []
                for i in range(words.n):
                    size = int(words.first[i + 1] - words.first[i])
                    cut = _marked(size, np.array(starts[i] or [], np.int64), window)
                    n.append(size)
                    gone.append(int(cut.sum()))
                    text.append(words.text(i, ~cut).decode())
                    edge = np.flatnonzero(np.diff(np.r_[0, cut.astype(np.int8), 0]))
                    spans.append(edge.tolist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, words.n), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(text, pa.string()), pa.array(spans, pa.list_(pa.int64()))], names=["doc_id", "n_words", "n_removed", "kept", "spans"])

    return docs.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, spans array<long>")


def dedup_substrings(docs: DataFrame, window: int = 50, period: int = PERIOD) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) and spans
    (word positions start, end, start, end, ... that went) of docs(doc_id, text).

    Words are runs of other bytes than ASCII white space, unchanged. A word goes if a
    window over it has the words of a window of a document with a smaller doc_id, judged
    on the input. Null and empty texts have no words. Rows that repeat a doc_id count as
    one document and should repeat its text; a row with a null doc_id keeps its words
    and takes nothing from others. Other columns are not read. Windows are compared by
    64-bit hashes. period must be below window; it sets how many anchors are hashed.
    """
    if not 1 < period < window:
        raise ValueError("period must lie between 1 and window")
    cover = np.zeros(period, bool)
    cover[list(difference_cover(period))] = True
    length = window - period + 1
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def anchors(batch):
        ids = batch.column(0).to_numpy()
        for at, words in _words(batch.column(1)):
            start, value = words.windows(length)
            doc = np.searchsorted(words.first, start, "right") - 1
            place = start - words.first[doc]
            # only texts that hold a whole window
            use = cover[place % period] & (np.diff(words.first)[doc] >= window)
            yield value[use].view(np.int64), ids[at + doc[use]], place[use]

    def windows(batch):
        ids, shared = batch.column(0).to_numpy(), batch.column(2)
        for at, words in _words(batch.column(1)):
            start, value = words.windows(window)
            mine = shared.slice(at, words.n)
            count = mine.value_lengths().to_numpy()
            where = mine.flatten().to_numpy() + np.repeat(words.first[:-1], count)
            low = np.maximum(where - period + 1, np.repeat(words.first[:-1], count))
            step = np.zeros(len(words.starts) + 1, np.int64)
            np.add.at(step, low, 1)
            np.add.at(step, where + 1, -1)
            use = (np.cumsum(step) > 0)[start]
            start, value = start[use], value[use]
            doc = np.searchsorted(words.first, start, "right") - 1
            yield value.view(np.int64), ids[at + doc], start - words.first[doc]

    known = docs.where("doc_id is not null")
    shared = meet(known, anchors).groupBy("owner").agg(F.collect_set("tag").alias("anchors")).withColumnRenamed("owner", "doc_id")
    some = saved(known.join(shared, "doc_id"), "anchored")
    gone = meet(some.select("doc_id", "text", "anchors"), windows, later=True)
    gone = gone.groupBy("owner").agg(F.collect_set("tag").alias("starts")).withColumnRenamed("owner", "doc_id")
    cut = saved(some.select("doc_id", "text").join(gone, "doc_id"), "cut")
    dropped(some)
    rest = docs.join(cut.select("doc_id"), "doc_id", "left_anti").withColumn("starts", F.lit(None).cast("array<long>"))
    return _kept(cut.union(rest), window)

