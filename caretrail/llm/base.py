"""What the operators of this subpackage share: scratch tables and word hashing.

Scratch tables are written as Parquet to the folder that the cluster names in
``spark.checkpoint.dir``, which the driver and all executors share. Hashing
works on whole Arrow batches with numpy; documents are never cut.
"""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Odd multipliers of the polynomial hashes (any odd numbers would do).
BYTE_BASE, WORD_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
#: Bytes of text that are hashed in one go; a longer document is one piece.
PIECE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a local one is made only in local mode where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there, so a
    lost executor repeats nothing before it. The files go when ``dropped`` is called or
    the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with unshuffled(spark):
        df.write.option("compression", "zstd").parquet(path)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    for record in _records:
        record.append(out)
    return out


_records: list[list[DataFrame]] = []


@contextmanager
def recorded():
    """Collects the tables that are saved meanwhile."""
    _records.append(tables := [])
    try:
        yield tables
    finally:
        _records[:] = [r for r in _records if r is not tables]


def dropped(*tables: DataFrame) -> None:
    """Deletes saved tables that nothing still to be computed reads."""
    for df in tables:
        spark = df.sparkSession
        there = spark._jvm.org.apache.hadoop.fs.Path(df.scratch)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


#: Spark's own switch: shuffle files go when the action that wrote them ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def unshuffled(spark: SparkSession):
    """Actions that are run meanwhile leave no shuffle files behind; without it, they stay
    until the driver's collector happens to take the plan they belong to."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- words -----------------------------------------------------------------

#: Bytes that belong to words: all but the ASCII white space ...
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: ... and letters, digits and every byte of a non-ASCII character.
WORD_CHAR = np.zeros(256, bool)
WORD_CHAR[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_rng = np.random.default_rng(20240229)
_EXACT = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _EXACT.copy()
_LOWER[0x41:0x5B] = _LOWER[0x61:0x7B]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0..n and their inverses modulo 2**64."""
    got = _powers.get(int(base))
    if got is None or len(got[0]) < n:
        size = max(n, 1 << 16) + 1
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        got = tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, b)])) for b in (base, inverse))
        if size <= PIECE_BYTES * 2:
            _powers[int(base)] = got
    return got


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """A 64-bit hash of values[start:end] for every pair, whatever stands before it."""
    up, down = _power(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


class Words:
    """The words of a run of texts: where they stand, their text's number and hash."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, inside: np.ndarray, lower: bool, hashed: bool = True):
        self.data, self.n = data, len(bounds) - 1
        ok = inside[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[bounds] = True
        before, after = np.zeros_like(ok), np.zeros_like(ok)
        before[1:], after[:-1] = ok[:-1], ok[1:]
        self.starts = np.flatnonzero(ok & (~before | cut[:-1]))
        self.ends = np.flatnonzero(ok & (~after | cut[1:])) + 1
        #: first[i]:first[i + 1] are the words of text i.
        self.first = np.searchsorted(self.starts, bounds)
        if hashed:
            self.hash = self.hashed(self.ends, lower)

    def hashed(self, ends: np.ndarray, lower: bool = True) -> np.ndarray:
        """Hashes of the bytes from each word's start to the given end in it, a run of
        words at a time, so that a very long text takes no more memory than others."""
        out = np.empty(len(self.starts), np.uint64)
        table, i = (_LOWER if lower else _EXACT), 0
        while i < len(out):
            at = int(self.starts[i])
            j = max(i + 1, int(np.searchsorted(self.ends, at + PIECE_BYTES, "right")))
            values = table[self.data[at : int(self.ends[j - 1])]]
            out[i:j] = range_hash(values, self.starts[i:j] - at, ends[i:j] - at, BYTE_BASE)
            i = j
        return out

    def text(self, i: int, keep: np.ndarray | None = None) -> bytes:
        """The words of text i, or those kept, joined by one space."""
        a, b = self.first[i], self.first[i + 1]
        at = np.arange(a, b) if keep is None else np.flatnonzero(keep) + a
        data = self.data.tobytes() if not hasattr(self, "_bytes") else self._bytes
        self._bytes = data
        return b" ".join([data[s:e] for s, e in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)])

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the k-word windows within one text, and their hashes."""
        last = np.repeat(self.first[1:], np.diff(self.first))
        at = np.flatnonzero(last - np.arange(len(self.starts)) >= k)
        return at, range_hash(self.hash, at, at + k, WORD_BASE)


def pieces(column: pa.Array | pa.ChunkedArray):
    """Cuts a string column between texts: (first row, bytes, offsets) of each piece.
    Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE_BYTES, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], (offsets[i : j + 1] - offsets[i]).astype(np.int64)
        i = j


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Of each text the sorted distinct k-word shingles, as 64-bit hashes; a text of
    fewer words, but some, has its whole sequence as one."""
    at, value = words.windows(k)
    edge = np.searchsorted(at, words.first)
    out = []
    for i in range(words.n):
        a, b = words.first[i], words.first[i + 1]
        if 0 < b - a < k:
            out.append(range_hash(words.hash[a:b], np.array([0]), np.array([b - a]), WORD_BASE))
        else:
            out.append(np.unique(value[edge[i] : edge[i + 1]]))
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
