"""Meeting of equal keys over all partitions, with little more than the keys moved.

Tasks hold (key, owner, tag) rows in numpy arrays, settle what they can among their
own rows, and send the rest once, as column blocks, to the partition of each key.
A key that many owners share leaves each task as one row, so a hot key costs its
partition one row a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import mix, partitions

#: Rows that a task holds before it settles and sends them; and rows of a partition, about,
#: that are settled at a time, a range of keys after another.
ROWS, SETTLED = 1 << 19, 1 << 18
#: Tags of the row that stands for a key with several owners, and of one with one owner.
_SEVERAL, _ONE = -2, -1

Rows = tuple[np.ndarray, np.ndarray, np.ndarray]


def _pack(x: np.ndarray) -> bytes:
    """int64s by byte plane, so that the shuffle's compression sees their zeros."""
    return np.ascontiguousarray(np.ascontiguousarray(x, np.int64).view(np.uint8).reshape(-1, 8).T).tobytes()


def _steps(x: np.ndarray) -> bytes:
    """Numbers in order, by their differences."""
    return _pack(np.diff(x.view(np.uint64), prepend=np.uint64(0)).view(np.int64))


def _unpack(block: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(block, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal keys."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return first, np.diff(np.r_[first, len(key)])


def meet(df: DataFrame, emit: Callable[[pa.RecordBatch], Iterator[Rows]], later: bool = False) -> DataFrame:
    """The rows (key, owner, tag) that emit makes of df's batches whose key has another
    owner too; with later, whose key has a smaller owner. Tags must not be negative.

    Exact: every row is judged against all owners of its key. An owner's equal rows
    may stand in any number of batches.
    """
    n = partitions(df.sparkSession)

    def send(batches):
        held: list[Rows] = []

        def flush():
            key, owner, tag = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(key)
            key, owner, tag = key[order], owner[order], tag[order]
            first, size = _groups(key)
            low = np.minimum.reduceat(owner, first)
            several = low != np.maximum.reduceat(owner, first)
            known = np.repeat(several, size)
            if later:
                known &= owner != np.repeat(low, size)
            # one row for each key with several owners here; with later, the rows of its first owner
            sent = ~known
            mark = first[several]
            flag = tag.copy()
            if not later:
                sent[mark] = True
                flag[mark] = _SEVERAL
            # numbers of 16 bits are sorted by radix
            part = (mix(key.view(np.uint64)) % np.uint64(n)).astype(np.uint16 if n <= 1 << 16 else np.int64)
            at = np.flatnonzero(sent)
            at = at[np.argsort(part[at], kind="stable")]
            edge = np.searchsorted(part[at], np.arange(n + 1))
            out = [(p, False, at[edge[p] : edge[p + 1]], flag) for p in range(n) if edge[p] < edge[p + 1]]
            # known rows pass through, dealt evenly
            at = np.flatnonzero(known)
            turn = int(part[0])
            out += [((turn + p) % n, True, x, tag) for p, x in enumerate(np.array_split(at, min(n, 1 + len(at) // 10_000))) if len(x)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.bool_())] + [pa.array([_steps(key[o[2]]) for o in out], pa.binary()), pa.array([_pack(owner[o[2]]) for o in out], pa.binary()), pa.array([_pack(o[3][o[2]]) for o in out], pa.binary())], names=["part", "known", "key", "owner", "tag"])

        count = 0
        for batch in batches:
            for rows in emit(batch):
                held.append(rows)
                count += len(rows[0])
                if count >= ROWS:
                    yield from flush()
                    count = 0
        if count:
            yield from flush()

    def rows(key, owner, tag):
        for i in range(0, len(key), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 50_000], pa.int64()) for x in (key, owner, tag)], names=["key", "owner", "tag"])

    def settled(key, owner, tag):
        order = np.argsort(key)
        key, owner, tag = key[order], owner[order], tag[order]
        first, size = _groups(key)
        low = np.minimum.reduceat(owner, first)
        if later:
            keep = owner != np.repeat(low, size)
        else:
            several = (low != np.maximum.reduceat(owner, first)) | (np.minimum.reduceat(tag, first) == _SEVERAL)
            keep = np.repeat(several, size)
        # the row that stood for its key has its own tag back only if it is asked for
        keep &= tag >= 0
        yield from rows(key[keep], owner[keep], tag[keep])

    def receive(batches):
        held: list[Rows] = []
        for batch in batches:
            for known, *block in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                steps, *rest = map(_unpack, block)
                got = (np.cumsum(steps.view(np.uint64)).view(np.int64), *rest)
                if known:
                    yield from rows(*got)
                else:
                    held.append(got)
        if not held:
            return
        # keys are in order in each block, so that a range of them is a slice of each
        most = max((x[0] for x in held), key=len)
        parts = 1 + sum(len(x[0]) for x in held) // SETTLED
        edges = most[np.arange(1, parts) * len(most) // parts]
        cuts = [np.r_[0, np.searchsorted(x[0], edges), len(x[0])] for x in held]
        for i in range(parts):
            some = [[c[a[i] : a[i + 1]] for c in x] for x, a in zip(held, cuts, strict=True) if a[i] < a[i + 1]]
            if some:
                yield from settled(*(np.concatenate(c) for c in zip(*some, strict=True)))

    sent = df.mapInArrow(send, "part int, known boolean, key binary, owner binary, tag binary")
    return sent.repartitionById(n, "part").mapInArrow(receive, "key long, owner long, tag long")
