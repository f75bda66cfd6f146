"""SentencePiece models of the merge type: encoding, decoding and counting.

Two independent ways to the same segmentation:

* ``MergeModel.encode`` keeps an agenda of adjacent symbol pairs, best score
  first and leftmost among equals, and merges until none is left.
* ``MergeModel.count`` holds many sequences as ragged numpy arrays and merges
  the lowest-rank pair of each of them in the same step.

No piece of such a model has a word mark after another character (checked when
it is loaded), so no merge crosses the start of a word: texts are cut there and
each distinct cut is worked out once per task. Texts are Unicode strings; null
counts as empty.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Runs of word marks (spaces) and what follows them up to the next.
_CUT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Distinct cuts that a task remembers; beyond, those not met
#: again are forgotten and worked out anew, with the same results.
REMEMBERED = 1 << 19
#: Characters of text that a task cuts at once.
AT_ONCE = 1 << 20
#: Longer cuts are counted by the agenda, whose work grows with n log n.
LONG = 400


class MergeModel:
    """A merge-type model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.vocab_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        odd = {i for i in range(n) if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in odd}
        if any(lib.is_unused(i) for i in range(n)) or any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("only merge-type models whose pieces keep to one word can be used")
        self.cost = {p: -lib.get_score(i) for p, i in self.ids.items()}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in odd if lib.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.last_byte = max(self.byte_of, default=-1)
        self.end, self.unknown = lib.eos_id(), lib.unk_id()
        if len(self.bytes) != 256:
            raise ValueError("the model must have a piece for each byte")
        self._tables = None

    # --- one sequence: an agenda of pairs ---

    def symbols(self, cut: str) -> list[str]:
        """Merges adjacent pairs whose union is a piece, highest score first, leftmost
        among equals, until no pair is left."""
        value, text, heappush, heappop = self.cost.get, list(cut), heapq.heappush, heapq.heappop
        n = len(text)
        agenda = []
        for i in range(n - 1):
            p = text[i] + text[i + 1]
            if (v := value(p)) is not None:
                agenda.append((v, i, p))
        if not agenda:
            return text
        heapq.heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            _, i, p = heappop(agenda)
            j = after[i]
            if j >= n or not text[i] or text[i] + text[j] != p:
                continue  # one of the two has been merged meanwhile
            text[i], text[j] = p, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (v := value(q := p + text[k])) is not None:
                    heappush(agenda, (v, i, q))
            if (h := before[i]) >= 0 and (v := value(q := text[h] + p)) is not None:
                heappush(agenda, (v, h, q))
        return [x for x in text if x]

    def encode_cut(self, cut: str) -> list[int]:
        out: list[int] = []
        for x in self.symbols(cut):
            i = self.ids.get(x)
            out += [i] if i is not None else [self.bytes[b] for b in x.encode()]
        return out

    def decode_cut(self, ids: list[int]) -> str:
        """Pieces back to text, word marks as spaces; runs of byte pieces as UTF-8."""
        if ids and min(ids) > self.last_byte:
            return "".join([self.pieces[i] for i in ids]).replace(MARK, " ")
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode(errors="replace"))
                run = bytearray()
            if i is not None:
                out.append(self.pieces[i].replace(MARK, " "))
        return "".join(out)

    @staticmethod
    def cuts(text: str) -> list[str]:
        """The text with a mark in front and for each space, cut before each word. Every
        cut begins with a mark, which is left out."""
        if not text:
            return []
        words = text.split(" ")
        if "" not in words and MARK not in text:
            return words
        return [c[1:] for c in _CUT.findall(MARK + text.replace(" ", MARK))]

    # --- many sequences: lowest-rank pairs in step ---

    def tables(self):
        """Symbol numbers of characters and pieces, and of each mergeable pair its key,
        rank and result, by key."""
        if self._tables is None:
            number = {p: i for i, p in enumerate(sorted({*self.ids, *(c for p in self.ids for c in p)}))}
            order = {c: r for r, c in enumerate(sorted(set(self.cost.values())))}
            size = len(number) + 1  # the last number: characters that no piece has
            found = sorted((number[p[:k]] * size + number[p[k:]], order[self.cost[p]], number[p]) for p in self.ids for k in range(1, len(p)) if p[:k] in number and p[k:] in number)
            self._tables = (number, size, *(np.array(x, np.int64) for x in zip(*found, strict=True)))
            #: Tokens that a symbol makes if it stays: bytes where it is no piece.
            self._weight = np.ones(size, np.int64)
            for p, i in number.items():
                if p not in self.ids:
                    self._weight[i] = len(p.encode())
        return self._tables

    def count(self, cuts: list[str]) -> np.ndarray:
        """Tokens of each cut (given without its mark). Ragged arrays: sym holds the symbols of all sequences one
        after another, row the sequence of each."""
        number, size, keys, ranks, results = self.tables()
        total = np.zeros(len(cuts), np.int64)
        short = [i for i, c in enumerate(cuts) if len(c) < LONG]
        cuts = [MARK + c for c in cuts]
        for i in {*range(len(cuts))} - {*short}:
            total[i] = len(self.encode_cut(cuts[i]))
        text = "".join(cuts[i] for i in short)
        row = np.repeat(np.array(short, np.int64), [len(cuts[i]) for i in short])
        other = size - 1
        sym = np.array([number.get(c, other) for c in text], np.int64)
        lost = np.array([len(c.encode()) for c in text if c not in number], np.int64)
        np.add.at(total, row[sym == other], lost - 1)
        none = np.iinfo(np.int64).max

        def rank_of(left, right):
            key = left * size + right
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = (keys[at] == key) & (left != other) & (right != other)
            return np.where(hit, ranks[at], none), results[at]

        while len(sym):
            same = row[:-1] == row[1:]
            rank, result = rank_of(sym[:-1], sym[1:])
            rank = np.where(same, rank, none)
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            best = np.minimum.reduceat(np.r_[rank, none], first)
            size_of = np.diff(np.r_[first, len(row)])
            done = np.repeat(best == none, size_of)
            if done.any():  # sequences without a pair left are counted and leave
                np.add.at(total, row[done], self._weight[sym[done]])
                stay = ~done
                rank, result = np.r_[rank, none][stay][:-1], np.r_[result, 0][stay][:-1]
                sym, row = sym[stay], row[stay]
                if not len(sym):
                    break
                first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                size_of, best = np.diff(np.r_[first, len(row)]), best[best != none]
            hit = np.flatnonzero(rank == np.repeat(best, size_of)[:-1])
            hit = hit[np.r_[True, row[hit][1:] != row[hit][:-1]]]  # the leftmost of each sequence
            sym[hit] = result[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, row = sym[keep], row[keep]
        return total


@lru_cache(2)
def model(path: str) -> MergeModel:
    return MergeModel(path)


def _path(name: str) -> str:
    """A vocabulary's file on the machine where a task runs."""
    import os

    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)


def _slices(batches, text: str):
    """Each batch in runs of rows with about AT_ONCE characters, and their texts; a
    longer text is a run of its own."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        size = np.cumsum(pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False))
        i = 0
        while i < len(size):
            j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + AT_ONCE, "right")))
            yield batch.slice(i, j - i), [t or "" for t in column.slice(i, j - i).to_pylist()]
            i = j


def encode(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", check: bool = True, ids: bool = False) -> DataFrame:
    """Encodes whole texts, an end id after each, and decodes the ids again.

    vocabulary: a model's path, or its name among the public ones, the same on every
    executor. Each distinct cut of a task is also encoded by the sentencepiece library,
    a batch of cuts at a time; a cut for which the two differ takes the library's ids
    and is counted in n_repaired (0 so far in all tests). Returns the columns of docs
    without text, and n_tokens, ids_sha256 (of the decimal ids joined by a space),
    decoded, n_repaired; with ids, the ids as well. Null and empty texts have the end
    id alone and decode to an empty text. Columns of docs that bear one of these names
    give way to the new ones.
    """
    new = {"n_tokens": "long", "ids_sha256": "string", "decoded": "string", "n_repaired": "long"} | ({"ids": "array<int>"} if ids else {})
    left = [c for c in docs.columns if c not in new and c != text]
    out = docs.sparkSession.createDataFrame([], ", ".join(f"{k} {v}" for k, v in new.items())).schema
    schema = docs.select(*left).schema
    for f in out:
        schema = schema.add(f)

    def run(batches):
        m = model(_path(vocabulary))
        known: dict[str, str] = {}  # decimal ids of a cut
        older, odd, wrong = known, {}, set()
        end = str(m.end)
        for batch, texts in _slices(batches, text):
            gc.disable()  # no cycles are made here; the many small tuples would set it off
            if len(known) > REMEMBERED:  # what is met again moves over from the older half
                older, known = known, {}
            cut = [m.cuts(t) for t in texts]
            fresh = {c: None for row in cut for c in row if c not in known}
            for c in [c for c in fresh if c in older]:
                known[c] = older[c]
                del fresh[c]
            own = [m.encode_cut(MARK + c) for c in fresh]
            # the library puts the leading mark back itself, but not on nothing
            theirs = m.library.encode([c.replace(MARK, " ") for c in fresh], num_threads=1) if check else own
            for c, o, t in zip(fresh, own, theirs, strict=True):
                if o != t and c:
                    wrong.add(c)
                    o = t
                known[c] = " ".join(map(str, o))
                if (back := m.decode_cut(o)) != " " + c.replace(MARK, " "):
                    odd[c] = back
            n, sha, decoded, repaired, lists = [], [], [], [], []
            for whole, row in zip(texts, cut, strict=True):
                line = " ".join([*map(known.__getitem__, row), end])
                n.append(line.count(" ") + 1)
                sha.append(hashlib.sha256(line.encode()).hexdigest())
                if odd and any(c in odd for c in row):
                    back = "".join([odd.get(c, " " + c.replace(MARK, " ")) for c in row])[1:]
                else:  # every cut decodes to itself behind a space; the first one is ours
                    back = whole.replace(MARK, " ")
                decoded.append(back)
                repaired.append(sum(c in wrong for c in row) if wrong else 0)
                if ids:
                    lists.append([int(x) for x in line.split(" ")])
            gc.enable()  # workers are used again for other functions
            columns = [batch.column(batch.schema.get_field_index(c)) for c in left]
            columns += [pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(decoded, pa.string()), pa.array(repaired, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(lists, pa.list_(pa.int32()))] if ids else []), names=schema.names)

    return docs.select(*left, F.col(text)).mapInArrow(run, schema)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 4096, text: str = "text") -> DataFrame:
    """docs without text, and n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Tokens are those of the library, without begin, end or other added ones. Null and
    empty texts have none. The cuts of a batch that the task has not met are counted
    together, merged in step.
    """
    left = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit", text)]
    schema = docs.select(*left).schema.add("n_bytes", "long").add("n_tokens", "long")

    def run(batches):
        m = model(_path(vocabulary))
        known: dict[str, int] = {}
        for batch, texts in _slices(batches, text):
            if len(known) > REMEMBERED:
                known.clear()
            cut = [m.cuts(t) for t in texts]
            fresh = list({c: None for row in cut for c in row if c not in known})
            for i in range(0, len(fresh), 20_000):
                part = fresh[i : i + 20_000]
                known.update(zip(part, m.count(part).tolist(), strict=True))
            size = [len(t.encode()) for t in texts]
            n = [sum(map(known.__getitem__, row)) for row in cut]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in left]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(size, pa.int64()), pa.array(n, pa.int64())], names=schema.names)

    out = docs.select(*left, F.col(text)).mapInArrow(run, schema)
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


def sha256(column: Column) -> Column:
    return F.sha2(F.encode(column, "UTF-8"), 256)
