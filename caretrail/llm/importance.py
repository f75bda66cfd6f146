"""Target-distribution importance resampling over hashed word n-grams.

A feature is a run of words joined by one space, its bucket the CRC-32 of its bytes
modulo the number of buckets. Each word's CRC is computed once; those of longer runs
follow by the algebra of CRCs: appending n bytes to a text multiplies its CRC by the n-th
power of a 32 x 32 matrix over GF(2), and the CRC of what was appended is added. No
n-gram is ever spelt out. Two passes over the texts: bucket counts (one row a bucket
leaves each task), then every document's weight by the finished gains.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import base
from .base import WORD_CHAR, Words, saved

#: Words of more bytes go through zlib one by one.
SHORT = 32
#: Words whose features are worked out at once, within one document too.
AT_ONCE = 1 << 18
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


# --- CRC algebra --------------------------------------------------------------


@lru_cache(maxsize=1)
def _step() -> np.ndarray:
    """What a zero byte makes of each low byte of the register."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (c & np.uint32(1)))
    return c


def _spread(columns: np.ndarray) -> np.ndarray:
    """A 32 x 32 matrix over GF(2), given by columns, as four tables by byte."""
    byte = np.arange(256)
    out = np.zeros((4, 256), np.uint32)
    for bit in range(8):
        on = (byte >> bit & 1).astype(bool)
        out[:, on] ^= columns.reshape(4, 8)[:, bit, None]
    return out


def _times(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.zeros_like(c)
    for k in range(4):
        out ^= tables[..., k, :][(c >> np.uint32(8 * k)) & np.uint32(255)]
    return out


@lru_cache(maxsize=1)
def _shifts() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables of the shifts by 0..SHORT bytes, and of those by each power of two."""
    unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
    one = _step()[unit & np.uint32(255)] ^ (unit >> np.uint32(8))
    few = [unit]
    for _ in range(SHORT):
        few.append(_times(_spread(one), few[-1]))
    powers = [one]
    for _ in range(31):
        powers.append(_times(_spread(powers[-1]), powers[-1]))
    return np.stack([_spread(x) for x in few]), [_spread(x) for x in powers]


def shifted(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs of texts, once n more bytes follow them (to be added to those bytes' CRC)."""
    few, powers = _shifts()
    out = np.zeros_like(c)
    short = np.minimum(n, SHORT)
    for k in range(4):
        out ^= few[short, k, (c >> np.uint32(8 * k)) & np.uint32(255)]
    long = np.flatnonzero(n > SHORT)
    if len(long):
        rest, x = n[long] - SHORT, out[long]
        for bit in range(int(rest.max()).bit_length()):
            on = (rest >> bit & 1).astype(bool)
            x[on] = _times(powers[bit], x[on])
        out[long] = x
    return out


def joined(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRC of two texts end to end: those of both, and the bytes of the second."""
    return shifted(a, n) ^ b


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:end] for each word: all words at once, byte by byte."""
    size = ends - starts
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    step, at = _step(), np.flatnonzero(size <= SHORT)
    for i in range(SHORT):
        at = at[size[at] > i]
        if not len(at):
            break
        c = out[at]
        out[at] = step[(c ^ data[starts[at] + i]) & np.uint32(255)] ^ (c >> np.uint32(8))
    out ^= np.uint32(0xFFFFFFFF)
    for w in np.flatnonzero(size > SHORT).tolist():
        out[w] = zlib.crc32(data[starts[w] : ends[w]])
    return out


# --- features -----------------------------------------------------------------


def _features(words: Words, n: int, buckets: int):
    """(text of each feature, its bucket), AT_ONCE words at a time: all runs of 1 to n words."""
    data, total = _LOWER[words.data], len(words.starts)
    text = np.repeat(np.arange(words.n), np.diff(words.first))
    space = np.uint32(zlib.crc32(b" "))
    for lo in range(0, total, AT_ONCE):
        hi, top = min(lo + AT_ONCE, total), min(lo + AT_ONCE + n - 1, total)
        size = words.ends[lo:top] - words.starts[lo:top]
        crc = word_crcs(data, words.starts[lo:top], words.ends[lo:top])
        run = crc[: hi - lo]
        yield text[lo:hi], run % np.uint32(buckets)
        for k in range(1, n):
            m = min(hi, total - k) - lo
            if m <= 0:
                break
            open_ = joined(run[:m], np.full(m, space), np.ones(m, np.int64))
            run = joined(open_, crc[k : k + m], size[k : k + m])
            within = text[lo : lo + m] == text[lo + k : lo + k + m]
            yield text[lo : lo + m][within], run[within] % np.uint32(buckets)


def bucket_counts(texts: DataFrame, n: int = 2, buckets: int = 10_000) -> DataFrame:
    """bucket and how many features of texts(text) fall there (buckets without any absent)."""

    def run(batches):
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, bounds in base.pieces(batch.column(0)):
                for _, bucket in _features(Words(data, bounds, WORD_CHAR, lower=True, hashed=False), n, buckets):
                    sums += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], names=["bucket", "n"])

    made = texts.select(F.col("text").cast("string")).mapInArrow(run, "bucket long, n long")
    return made.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, n: int = 2, buckets: int = 10_000) -> np.ndarray:
    """Of each bucket floor(1000 * ln) of its smoothed share in the target over that in docs."""

    def counted(texts):
        out = [0] * buckets
        for r in bucket_counts(texts, n, buckets).collect():  # a row a bucket
            out[r.bucket] = r.n
        return out, sum(out)

    (s, all_s), (t, all_t) = counted(docs), counted(target)
    return np.array([math.floor(1000 * math.log(float((t[i] + 1) * (all_s + buckets)) / float((s[i] + 1) * (all_t + buckets)))) for i in range(buckets)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, n: int = 2) -> DataFrame:
    """doc_id, n_words, n_features and weight (the floored mean gain; 0 without features)."""
    buckets = len(gain)

    def run(batches):
        for batch in batches:
            for at, data, bounds in base.pieces(batch.column(1)):
                words = Words(data, bounds, WORD_CHAR, lower=True, hashed=False)
                count, total = np.zeros(words.n, np.int64), np.zeros(words.n, np.int64)
                for text, bucket in _features(words, n, buckets):
                    if len(text):
                        first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
                        count[text[first]] += np.diff(np.r_[first, len(text)])
                        total[text[first]] += np.add.reduceat(gain[bucket], first)
                made = [np.diff(words.first), count, total // np.maximum(count, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, words.n), *(pa.array(x, pa.int64()) for x in made)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, n: int = 2, buckets: int = 10_000, percent: int = 25, least_words: int = 20, key: int = 7) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of each row of docs(doc_id, text).

    Words are runs of letters, digits and non-ASCII characters, A-Z in lower case; features
    all runs of 1 to n of them. The score adds Gumbel noise, which follows from key and
    doc_id, to the weight, so the ``percent`` of documents with the highest scores are a draw
    without replacement by importance (of documents with ``least_words`` or more; equal
    scores by doc_id). rank counts the drawn from 1; others have null. Null and empty texts
    have no features and weight 0. A null doc_id draws its noise as the text "null" and
    stands before others of its score; rows that repeat a doc_id are documents of their own
    with the same noise, and equal ones share their places in any order. Very long texts
    are worked through in runs of words. Other columns are not read; an empty table gives
    an empty result, an empty target smoothed counts alone.
    """
    scored = weights(docs, gains(docs, target, n, buckets), n)
    digits = F.substring(F.sha2(F.concat(F.lit(f"{key}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(-1000 * F.log(-F.log(u))).cast("long")
    scored = saved(scored.withColumn("score", F.col("weight") + noise), "scored")
    may = F.col("n_words") >= least_words
    # scores are whole numbers between logarithms of counts: some 100,000 values at most, however many documents
    sizes = scored.where(may).groupBy("score").agg(F.count("*").alias("n"))
    below = W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)
    starts = saved(sizes.withColumn("start", F.coalesce(F.sum("n").over(below), F.lit(0))), "starts")
    found = starts.agg(F.sum("n")).first()[0] or 0
    quota = found * percent // 100
    cut = starts.where(F.col("start") < quota).agg(F.min("score")).first()[0]
    reached = may & (F.col("score") >= (cut if cut is not None else F.lit(None).cast("long")))
    nth = F.row_number().over(W.partitionBy("score").orderBy("doc_id")).cast("long")
    drawn = scored.where(reached).withColumn("nth", nth).join(F.broadcast(starts.drop("n")), "score")
    place = F.col("start") + F.col("nth")
    drawn = drawn.withColumn("rank", F.when(place <= quota, place))
    out = ("doc_id", "n_words", "n_features", "weight", "score", "rank")
    rest = scored.where(~F.coalesce(reached, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(*out).union(rest.select(*out))
