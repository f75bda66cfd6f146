"""Exact top-k inner products by a bit-sliced index.

Vectors become integers, floor(scale * x). The index keeps blocks of rows by bit: slice
b of dimension j is a bitmap of the rows whose j-th integer, less the block's smallest,
has bit b set. The scores of a whole block against one query are then sums of slices,
made with AND, OR and XOR on bitmaps (carry-save adders, the query's bits from the
highest down). The top rows are picked from the most significant slice of the sum
downward: rows with the bit stand above all others that were equal so far. Rows that
stay equal to the end are the boundary; of them the smallest ids are taken. Integer
scores make the result exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import saved

#: Rows of a block, and queries that go to a block together.
ROWS, QUERIES = 8192, 64
#: Integers are held to this much either way, and scores to what a long holds.
LARGEST, LONG = 1 << 62, (1 << 63) - 1


def _bitmap(bits: np.ndarray) -> np.ndarray:
    """Booleans along the last axis as uint64 words."""
    packed = np.packbits(bits, axis=-1, bitorder="little")
    pad = -packed.shape[-1] % 8
    return np.ascontiguousarray(np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, pad)])).view(np.uint64)


def _add(x, y, z):
    """Three sliced numbers as two: sum and carry."""
    a = x ^ y
    carry = (x & y) | (z & a)
    a ^= z
    carry[1:] = carry[:-1]  # one place up; the widths leave room
    carry[0] = 0
    return a, carry


def _total(numbers: list[np.ndarray], width: int):
    """Sliced numbers (slices by words), added up to a pair of the given width."""
    wide = []
    for x in numbers:
        y = np.zeros((width, x.shape[1]), np.uint64)
        y[: len(x)] = x[:width]
        wide.append(y)
    while len(wide) > 2:
        rest = wide[len(wide) // 3 * 3 :]
        wide = [y for i in range(0, len(wide) // 3 * 3, 3) for y in _add(*wide[i : i + 3])] + rest
    return wide


def _scores(slices: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, int]:
    """Slices of sum(|q| * u), u complemented where q is negative, and what to add."""
    dims, bits, words = slices.shape
    size = np.abs(query)
    high = int(size.max()).bit_length() if dims else 0
    narrow = bits + int(dims).bit_length() + 1
    width = narrow + high + 1
    flipped = {j: ~slices[j] for j in np.flatnonzero(query < 0).tolist()}
    total = [np.zeros((width, words), np.uint64)] * 2
    for b in range(high - 1, -1, -1):
        total = [np.concatenate([np.zeros((1, words), np.uint64), x[:-1]]) for x in total]
        plane = _total([flipped.get(j, slices[j]) for j in np.flatnonzero(size >> b & 1).tolist()], narrow)
        total = _total(total + plane, width)
    x, y = total
    out, carry = np.empty_like(x), np.zeros(words, np.uint64)
    for i in range(width):  # the last addition, place by place
        a = x[i] ^ y[i]
        out[i] = a ^ carry
        carry = (x[i] & y[i]) | (carry & a)
    return out, -int(size[query < 0].sum()) * ((1 << bits) - 1)


def _top(total: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k largest rows among those of a bitmap; ties to the first rows."""
    above, equal = np.zeros_like(rows), rows
    for slice_ in total[::-1]:
        more = above | (equal & slice_)
        n = int(np.bitwise_count(more).sum())
        if n > k:
            equal = equal & slice_
        else:
            above, equal = more, equal & ~slice_
            if n == k:
                break
    numbers = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
    sure = numbers(above)
    return np.concatenate([sure, numbers(equal)[: max(0, k - len(sure))]])


def _fits(slices: np.ndarray, low: np.ndarray, query: np.ndarray) -> bool:
    """Whether all sums over these slices stay within 62 bits."""
    dims, bits, _ = slices.shape
    high = max(int(query.max()), -int(query.min())).bit_length()
    reach = max(bits, max(int(low.max()), -int(low.min())).bit_length())
    return reach + high + dims.bit_length() + 2 <= 62


def _large(slices: np.ndarray, low: np.ndarray, query: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same top rows and their scores with integers of any size: for the few blocks
    and queries with components beyond what the slices' sums can hold."""
    bits = np.unpackbits(slices.view(np.uint8), axis=-1, bitorder="little")
    keep = np.flatnonzero(np.unpackbits(rows.view(np.uint8), bitorder="little"))
    score = np.zeros(len(keep), object)
    for j, (q, base) in enumerate(zip(query.tolist(), low.tolist(), strict=True)):
        value = sum((bits[j, b, keep].astype(object) << b for b in range(bits.shape[1])), np.zeros(len(keep), object))
        score += (value + base) * q
    order = sorted(range(len(keep)), key=lambda i: (-max(-LONG - 1, min(LONG, score[i])), i))[:k]
    return keep[order], np.array([max(-LONG - 1, min(LONG, score[i])) for i in order], np.int64)


def usable(column: str) -> F.Column:
    return F.col(column).isNotNull() & (F.size(column) > 0) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def build_index(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """Blocks of vectors(vec_id, embedding), saved: dims, block, blocks (how many there
    are), ids, low (smallest integer of each dimension), bits and slices."""
    good = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(usable("embedding") & F.col("vec_id").isNotNull())
    good = good.withColumn("dims", F.size("embedding"))
    n = max(1, -(-good.count() // ROWS))
    blocks = good.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))

    def build(rows: pa.Table) -> pa.Table:
        ids = rows["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        flat = rows["embedding"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        value = np.clip(np.floor(flat * float(scale)), -float(LARGEST), float(LARGEST)).astype(np.int64)[order]
        low = value.min(axis=0)
        value = value.view(np.uint64) - low.view(np.uint64)
        bits = max(1, int(value.max()).bit_length())
        slices = np.stack([_bitmap((value >> np.uint64(b) & np.uint64(1)).T.astype(bool)) for b in range(bits)], axis=1)
        return pa.table({"dims": pa.array([flat.shape[1]], pa.int32()), "block": rows["block"][:1], "ids": pa.array([ids[order].tolist()], pa.list_(pa.int64())), "low": pa.array([low.tolist()], pa.list_(pa.int64())), "bits": pa.array([bits], pa.int32()), "slices": pa.array([slices.tobytes()], pa.binary())})

    made = blocks.groupBy("dims", "block").applyInArrow(build, "dims int, block int, ids array<long>, low array<long>, bits int, slices binary")
    return saved(made.withColumn("blocks", F.lit(n)), "slices")


def search(index: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest scores of each query against all
    rows of the index but its own id, ties to the smaller vec_id; all if there are fewer.

    queries(vec_id, embedding) are a stated query set: they go to all blocks, QUERIES at
    a time. Vectors of queries and index that are null, empty, or hold a null or a
    non-finite component take no part; vectors of different lengths don't meet. Rows
    that repeat a vec_id each count as a row, though none is a candidate of a query of that
    id. Integers beyond 2**62 either way count as that much; sums are exact, and scores
    beyond a long count, and rank, as the largest or smallest one. Other columns are not
    read; empty tables give an empty result.
    """
    good = queries.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(usable("embedding") & F.col("vec_id").isNotNull())
    q = good.select("vec_id", F.size("embedding").alias("dims"), F.transform("embedding", lambda x: F.floor(F.least(F.greatest(x * F.lit(float(scale)), F.lit(-float(LARGEST))), F.lit(float(LARGEST))))).alias("q"))
    parts = max(1, -(-q.count() // QUERIES))
    q = q.groupBy("dims", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct("vec_id", "q")).alias("queries"))
    where = index.select("dims", "block").distinct()
    pairs = q.join(where, "dims").join(index.drop("blocks"), ["dims", "block"])

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at] for c in batch.schema.names}
                ids, low = np.array(row["ids"].as_py(), np.int64), np.array(row["low"].as_py(), np.int64)
                slices = np.frombuffer(row["slices"].as_buffer(), np.uint64).reshape(len(low), row["bits"].as_py(), -1)
                everything = _bitmap(np.ones(len(ids), bool))
                out = []
                for one in row["queries"].as_py():
                    query = np.array(one["q"], np.int64)
                    others = everything & ~_bitmap(ids == one["vec_id"])
                    if not _fits(slices, low, query):
                        top, score = _large(slices, low, query, others, k)
                        out += zip([one["vec_id"]] * len(top), ids[top].tolist(), score.tolist(), strict=True)
                        continue
                    total, add = _scores(slices, query)
                    add += int((query * low).sum())
                    top = _top(total, others, k)
                    word, bit = top // 64, (top % 64).astype(np.uint64)
                    score = sum(((total[i][word] >> bit & np.uint64(1)).astype(np.int64) << i for i in range(len(total))), np.zeros(len(top), np.int64)) + add
                    out += zip([one["vec_id"]] * len(top), ids[top].tolist(), score.tolist(), strict=True)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    best = pairs.select("ids", "low", "bits", "slices", "queries").mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
