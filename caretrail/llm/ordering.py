"""Training-order materialisation: every sequence gets a slot of a keyed permutation.

Token ids are cut into sequences of a fixed length, numbered densely, and the number is
permuted by a Feistel network over the next even power of two; a result that is no valid
number goes through it again until it is one (cycle-walking), so the slots are exactly
0..n-1. Slots go to shards by range. ``write_shards`` lays each shard down as one file of
records of the same number of bytes, in slot order: slot s stands at byte
(s % slots_per_shard) * stride of file s // slots_per_shard, so a reader goes on from any
slot by one seek. Nothing is sampled or sorted globally: a slot's partition follows from its
number.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import partitions, saved

ROUNDS = 6
#: Bytes of a partition of sequences: their number follows from the data.
PART_BYTES = 32 << 20
#: A record's header: doc_id (the least long stands for null), seq, n_ids.
HEADER = np.dtype([("doc_id", "<i8"), ("seq", "<i8"), ("n_ids", "<i8")])
_NULL_ID = -(1 << 63)


def _round_keys(key: int) -> list[int]:
    rng = np.random.default_rng(key)
    return [int(x) for x in rng.integers(1, 1 << 63, ROUNDS)]


def feistel(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of 0..n-1, by key, of the numbers x of that range."""
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(k) for k in _round_keys(key)]

    def once(v):
        left, right = v >> np.uint64(half), v & mask
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ (mixed >> np.uint64(64 - half))
        return left << np.uint64(half) | right

    out = once(x.astype(np.uint64))
    while (far := out >= n).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def slot(number: Column, n: int, key: int) -> Column:
    @F.pandas_udf("long")
    def permuted(x: pd.Series) -> pd.Series:
        return pd.Series(feistel(x.to_numpy(), n, key))

    return permuted(number)


def numbered(rows: DataFrame, count: str, tie: str) -> tuple[DataFrame, int]:
    """rows with base: how much ``count`` adds up to in the rows before it, by doc_id
    (nulls first; rows that repeat an id in the order of tie), and the whole sum.

    Running totals in three levels, 2**12 ids in a group and 2**12 groups in a block, so
    that no task holds more than that, or the rows that repeat one id.
    """
    group = F.coalesce(F.shiftright("doc_id", 12), F.lit(-(1 << 52)) + F.pmod(F.col(tie), F.lit(4096)))
    rows = rows.withColumn("_g", group)
    before = (W.unboundedPreceding, -1)
    sums = rows.groupBy("_g").agg(F.sum(count).alias("s")).withColumn("_b", F.shiftright("_g", 12))
    sums = saved(sums, "counts")
    blocks = sums.groupBy("_b").agg(F.sum("s").alias("t"))
    total = sums.agg(F.sum("s")).first()[0] or 0
    zero = lambda c: F.coalesce(c, F.lit(0))
    blocks = blocks.select("_b", zero(F.sum("t").over(W.orderBy("_b").rowsBetween(*before))).alias("b"))
    sums = sums.select("_b", "_g", zero(F.sum("s").over(W.partitionBy("_b").orderBy("_g").rowsBetween(*before))).alias("g"))
    starts = sums.join(blocks, "_b").select("_g", (F.col("b") + F.col("g")).alias("_start"))
    inner = zero(F.sum(count).over(W.partitionBy("_g").orderBy("doc_id", tie).rowsBetween(*before)))
    out = rows.withColumn("base", inner).join(starts, "_g")
    return out.withColumn("base", F.col("base") + F.col("_start")).drop("_g", "_start"), total


def training_order(docs: DataFrame, length: int = 2048, key: int = 17, slots_per_shard: int = 4096, ids: str | None = None) -> DataFrame:
    """(shard, slot, doc_id, seq, n_ids, payload) of docs(doc_id, text), shard by shard,
    in slot order.

    A payload holds ``length`` ids of 16 bits, little-endian. With ``ids``, the name of a
    column array<int> such as ``pieces.encode`` makes, they are its numbers plus one (which
    must fit 16 bits); without, the text's UTF-8 bytes plus one. An id of 0 ends each
    document, and more of them fill its last sequence. seq numbers a document's sequences
    from 0; n_ids of a payload's ids belong to the document, its end included. Null and
    empty texts make one sequence, of the end alone. Rows that repeat a doc_id are documents
    of their own, in the order of a hash of their content (equal ones are alike in every
    slot they may get); all rows of one id are one window partition of narrow numbering.
    Very long texts become many sequences, cut one by one. Other columns are not read, and
    an empty table gives an empty result. Partitions hold whole ranges of shards.
    """
    spark = docs.sparkSession
    width = 2 if ids else 1
    if ids:
        too_large = F.raise_error(F.lit("ids must lie in 0..65534"))
        checked = F.when(F.exists(ids, lambda x: x.isNull() | (x < 0) | (x > 65534)), too_large).otherwise(F.col(ids))
        digits = F.transform(checked, lambda x: F.concat(F.substring(F.hex(x + 65536 + 1), 4, 2), F.substring(F.hex(x + 65536 + 1), 2, 2)))
        data = F.coalesce(F.unhex(F.array_join(digits, "")), F.to_binary(F.lit("")))
    else:
        data = F.coalesce(F.encode(F.col("text").cast("string"), "UTF-8"), F.to_binary(F.lit("")))
    stride = length * width
    rows = docs.select(F.col("doc_id").cast("long"), data.alias("data")).withColumn("tie", F.xxhash64("data"))
    rows = rows.withColumn("count", F.floor(F.octet_length("data") / stride).cast("long") + 1)
    rows, n = numbered(rows, "count", "tie")
    if not n:
        return spark.createDataFrame([], "shard long, slot long, doc_id long, seq long, n_ids long, payload binary")
    seqs = rows.select("doc_id", "data", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("seq"))
    part = F.expr(f"substring(data, cast(seq * {stride} + 1 as int), {stride})")
    seqs = seqs.select(slot(F.col("base") + F.col("seq"), n, key).alias("slot"), "doc_id", "seq", part.alias("part"))
    shards = -(-n // slots_per_shard)
    parts = min(shards, max(partitions(spark), -(-n * stride // PART_BYTES)))
    seqs = seqs.withColumn("shard", F.floor(F.col("slot") / slots_per_shard).cast("long"))
    seqs = seqs.repartitionById(parts, F.floor(F.col("shard") * parts / shards).cast("int")).sortWithinPartitions("slot")

    def lay(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                some = batch.slice(i, 512)
                raw = some.column(4).to_pylist()
                out = np.zeros((len(raw), length), "<u2")
                size = np.array([len(x) // width for x in raw])
                got = np.frombuffer(b"".join(raw), "<u2" if ids else np.uint8).astype("<u2")
                out[np.arange(length) < size[:, None]] = got if ids else got + 1
                last = size < length  # the end id has room in a document's last sequence only
                payload = pa.array([x.tobytes() for x in out], pa.binary())
                yield pa.RecordBatch.from_arrays([*some.columns[:4], pa.array(size + last, pa.int64()), payload], names=["shard", "slot", "doc_id", "seq", "n_ids", "payload"])

    return seqs.select("shard", "slot", "doc_id", "seq", "part").mapInArrow(lay, "shard long, slot long, doc_id long, seq long, n_ids long, payload binary")


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_shards(order: DataFrame, path: str) -> DataFrame:
    """Writes ``order`` (as ``training_order`` returns it) to path, a folder that all
    executors share: one file a shard, ``<shard>.bin``, a record a slot: HEADER, then the
    payload. A shard is written under a name of its own and renamed when it is whole, so a
    task that is repeated, or runs twice, leaves the same files. Returns (shard, slots,
    stride), which is also kept beside them as Parquet."""

    def write(batches):
        place, base = _place(path)
        place.create_dir(base, recursive=True)
        now, sink, name, slots, stride = None, None, "", 0, 0

        def close():
            sink.close()
            place.move(name, f"{base}/{now}.bin")
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (now, slots, stride)], names=["shard", "slots", "stride"])

        for batch in batches:
            shard = batch.column(0).to_numpy()
            for lo in np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]).tolist() if len(shard) else []:
                hi = int(np.searchsorted(shard, shard[lo], "right"))
                some = batch.slice(lo, hi - lo)
                if shard[lo] != now:
                    if now is not None:
                        yield close()
                    now, slots, name = int(shard[lo]), 0, f"{base}/.{shard[lo]}-{uuid.uuid4().hex}"
                    sink = place.open_output_stream(name)
                head = np.zeros(hi - lo, HEADER)
                head["doc_id"] = some.column(2).fill_null(_NULL_ID).to_numpy()
                head["seq"], head["n_ids"] = some.column(3).to_numpy(), some.column(4).to_numpy()
                body = some.column(5).to_pylist()
                stride = HEADER.itemsize + len(body[0])
                sink.write(b"".join(x for h, b in zip(head, body, strict=True) for x in (h.tobytes(), b)))
                slots += hi - lo
        if now is not None:
            yield close()

    done = order.mapInArrow(write, "shard long, slots long, stride long")
    done.write.mode("overwrite").parquet(f"{path}/_shards")
    return order.sparkSession.read.schema(done.schema).parquet(f"{path}/_shards")


def read_from(spark: SparkSession, path: str, at: int, slots_per_shard: int = 4096) -> DataFrame:
    """(slot, doc_id, seq, n_ids, payload) from slot ``at`` on, shard by shard: shards
    before it are not opened, and its own is read from the slot's offset."""

    def read(batches):
        place, base = _place(path)
        for batch in batches:
            for shard, slots, stride in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                skip = max(0, at - shard * slots_per_shard)
                with place.open_input_file(f"{base}/{shard}.bin") as file:
                    file.seek(skip * stride)
                    while skip < slots:
                        n = min(1024, slots - skip)
                        raw = np.frombuffer(file.read(n * stride), np.uint8).reshape(n, stride)
                        head = np.ascontiguousarray(raw[:, : HEADER.itemsize]).view(HEADER).ravel()
                        ids = pa.array(head["doc_id"], mask=head["doc_id"] == _NULL_ID)
                        body = pa.array([x.tobytes() for x in raw[:, HEADER.itemsize :]], pa.binary())
                        slot_ = np.arange(skip, skip + n) + shard * slots_per_shard
                        yield pa.RecordBatch.from_arrays([pa.array(slot_), ids, pa.array(head["seq"]), pa.array(head["n_ids"]), body], names=["slot", "doc_id", "seq", "n_ids", "payload"])
                        skip += n

    files = spark.read.parquet(f"{path}/_shards").where(F.col("shard") >= at // slots_per_shard)
    return files.orderBy("shard").mapInArrow(read, "slot long, doc_id long, seq long, n_ids long, payload binary")
