"""A positional inverted index of training text, and benchmark passages found in it.

``build_index`` stores the postings of all words as a table of segments: a segment
holds whole documents of about ``base.PIECE_BYTES`` and lists, for each term, the word
positions where it occurs. Segments are made and searched where they lie, so nothing
is shuffled and a hot term costs each segment its own list only. A phrase is searched
from its rarest term in the segment: that list, less the term's offset, is intersected
with the next rarer one, and so on; most phrases end at a term that is not there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .base import WORD_CHAR, Words, saved

#: Benchmark text that is searched for, and held by the driver, at once.
BLOCK_BYTES = 8 << 20

_INDEX = "doc_ids array<long>, first array<int>, terms binary, starts binary, positions binary"


def build_index(docs: DataFrame) -> DataFrame:
    """The postings of docs(doc_id, text), saved. Words are runs of letters, digits and
    non-ASCII characters, A-Z in lower case; null has none."""

    def run(batches):
        for batch in batches:
            for at, data, bounds in base.pieces(batch.column(1)):
                words = Words(data, bounds, WORD_CHAR, lower=True)
                order = np.argsort(words.hash, kind="stable")
                terms = words.hash[order]
                starts = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.zeros(0, np.int64)
                ids = batch.column(0).slice(at, words.n)
                one = [pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([words.first.astype(np.int32)], pa.list_(pa.int32()))]
                one += [pa.array([x.tobytes()], pa.binary()) for x in (terms[starts], np.r_[starts, len(terms)].astype(np.int32), order.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(one, names=["doc_ids", "first", "terms", "starts", "positions"])

    return saved(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _INDEX), "postings")


def sizes(index: DataFrame) -> DataFrame:
    """doc_id and n_words of every document in the index."""
    n = F.transform(F.sequence(F.lit(1), F.size("doc_ids")), lambda i: F.element_at("first", i + 1) - F.element_at("first", i))
    return index.where("size(doc_ids) > 0").select(F.explode(F.arrays_zip(F.col("doc_ids").alias("d"), n.alias("n"))).alias("x")).select(F.col("x.d").alias("doc_id"), F.col("x.n").cast("long").alias("n_words"))


class _Segment:
    def __init__(self, first, terms: bytes, starts: bytes, positions: bytes):
        self.first = np.asarray(first, np.int64)
        self.terms = np.frombuffer(terms, np.uint64)
        self.starts, self.positions = np.frombuffer(starts, np.int32), np.frombuffer(positions, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each term, or -1."""
        at = np.minimum(np.searchsorted(self.terms, hashes), max(len(self.terms) - 1, 0))
        return np.where(self.terms[at] == hashes, at, -1) if len(self.terms) else np.full(hashes.shape, -1)

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.starts[term] : self.starts[term + 1]]

    def within(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the runs of words at given places those that keep to one document, and it."""
        doc = np.searchsorted(self.first, at, "right") - 1
        ok = (at >= 0) & (at + length <= self.first[np.minimum(doc + 1, len(self.first) - 1)]) & (doc >= 0)
        return at[ok], doc[ok]

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Starts of the phrase: offset-adjusted lists, intersected from the rarest."""
        size = self.starts[terms + 1] - self.starts[terms]
        at = None
        for o in np.argsort(size, kind="stable").tolist():
            mine = self.postings(terms[o])
            if at is None:
                at = mine.astype(np.int64) - o
                continue
            k = np.minimum(np.searchsorted(mine, at + o), len(mine) - 1)
            at = at[mine[k] == at + o]
            if not len(at):
                break
        return at

    def near(self, terms: np.ndarray, span: int) -> np.ndarray:
        """Starts of the shortest runs of up to span words that hold all the terms, one
        for each occurrence of the rarest term that has some."""
        terms = np.unique(terms)
        rarest, *others = sorted((self.postings(t) for t in terms), key=len)
        out = []
        for p in rarest.tolist():
            lists = [x[np.searchsorted(x, p - span + 1) : np.searchsorted(x, p + span)] for x in others]
            if all(map(len, lists)):
                at = np.concatenate([[p], *lists])
                kind = np.repeat(np.arange(len(lists) + 1), [1, *map(len, lists)])
                order = np.argsort(at, kind="stable")
                at, kind, last, best = at[order], kind[order], {}, None
                for a, t in zip(at.tolist(), kind.tolist(), strict=True):
                    last[t] = a
                    if len(last) == len(lists) + 1 and a - min(last.values()) < span and (best is None or a - min(last.values()) < best[1] - best[0]):
                        best = min(last.values()), a
                if best:
                    out.append(best)
        return np.array(sorted(set(out)), np.int64).reshape(-1, 2)


def _blocks(items: DataFrame):
    """The items' ids and texts, BLOCK_BYTES at a time."""
    items = items.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + total // BLOCK_BYTES
    for i in range(n):
        yield items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()


def find_passages(index: DataFrame, items: DataFrame, window: int = 13, span: int | None = None) -> DataFrame:
    """(doc_id, item_id, start, stop): the words of documents inside occurrences of items.

    items(item_id, text); an item's windows are its runs of ``window`` words, or the
    whole of a shorter one. Overlapping occurrences of one item are joined. With span,
    proximity instead: the shortest runs of up to span words that hold all words of a
    window in any order. Items without words or id match nothing. The items are a stated
    query set: they are searched in blocks of bounded size, each against all segments.
    """
    found = None
    for rows in _blocks(items):
        words = Words(*_buffers([r.text for r in rows]), WORD_CHAR, lower=True)
        phrases: dict[tuple[int, ...], list[str]] = {}
        for i, r in enumerate(rows):
            terms = words.hash[words.first[i] : words.first[i + 1]].tolist()
            for k in range(max(1, len(terms) - window + 1) if terms else 0):
                who = phrases.setdefault(tuple(terms[k : k + window]), [])
                if r.item_id not in who:
                    who.append(r.item_id)
        part = _search(index, phrases, window, span)
        found = part if found is None else found.union(part)
    return found.dropDuplicates()


def _buffers(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64)


def _search(index: DataFrame, phrases: dict[tuple[int, ...], list[str]], window: int, span: int | None) -> DataFrame:
    keys = list(phrases)
    size = np.array([len(k) for k in keys], np.int64)
    grid = np.zeros((len(keys), window), np.uint64)
    for i, k in enumerate(keys):
        grid[i, : len(k)] = k
    real = np.arange(window) < size[:, None]
    whose = [phrases[k] for k in keys]

    def run(batches):
        for batch in batches:
            for ids, *parts in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                s = _Segment(*parts)
                number = s.find(grid)
                rows: dict[tuple[int, str], list[tuple[int, int]]] = {}
                for w in np.flatnonzero(((number >= 0) | ~real).all(axis=1)).tolist() if len(keys) else []:
                    terms = number[w, : size[w]]
                    if span:
                        runs = [(a, b + 1) for a, b in s.near(terms, span).tolist()]
                    else:
                        runs = [(a, a + int(size[w])) for a in s.phrase(terms).tolist()]
                    for a, b in runs:
                        at, doc = s.within(np.array([a]), b - a)
                        for d in doc.tolist():
                            for item in whose[w]:
                                rows.setdefault((d, item), []).append((a - int(s.first[d]), b - int(s.first[d])))
                out = []
                for (d, item), runs in rows.items():
                    runs.sort()
                    joined = [list(runs[0])]
                    for a, b in runs[1:]:
                        if a <= joined[-1][1]:
                            joined[-1][1] = max(b, joined[-1][1])
                        else:
                            joined.append([a, b])
                    out += [(ids[d], item, a, b) for a, b in joined]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "start", "stop"])

    return index.mapInArrow(run, "doc_id long, item_id string, start long, stop long")


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, percent: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted ids) and contaminated of each row
    of docs(doc_id, text).

    A word is hit if it lies inside an occurrence of a window of an item; a document is
    contaminated if some are and they are percent of its words or more. Null and empty
    texts have no words and are not. Rows that repeat a doc_id should repeat its text.
    Rows with a null doc_id are never contaminated. Other columns are not read.
    """
    index = build_index(docs)
    found = saved(find_passages(index, items, window), "passages")
    hit = found.select("doc_id", F.explode(F.sequence("start", F.col("stop") - 1)).alias("w")).distinct().groupBy("doc_id").agg(F.count("*").alias("n_hit"))
    who = found.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = sizes(index).join(hit.join(who, "doc_id"), "doc_id", "left")
    out = out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", F.expr(f"n_hit > 0 and 100 * n_hit >= {percent} * n_words").alias("contaminated"))
