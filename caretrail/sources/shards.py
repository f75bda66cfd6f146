"""Compiled timelines as shards with an index, and readers that open only what they need.

    timelines/shard=<k>  tokens of whole subjects, in order of subject and idx
    index                subject_id, shard, rel_path, subject_idx, n and split, by subject

A subject's shard follows from its id, so one subject is read from one folder; a split is read
from the shards that hold its subjects. Spark prunes the folders and, by the order within them,
the row groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TARGET_BYTES = 128 << 20
#: Bytes of a token beside its texts.
FIXED_BYTES = 64
OTHER_NAMES = {"val": "tuning", "test": "held_out"}


def shard_of(subject: Column, shards: int) -> Column:
    return (F.crc32(F.encode(subject.cast("string"), "UTF-8")) % shards).cast("int")


def shard_count(tokens: DataFrame, target_bytes: int = TARGET_BYTES) -> int:
    """How many shards of about target_bytes the tokens make: from the sum of their sizes."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in tokens.dtypes if kind == "string"]
    size = sum(texts, F.lit(FIXED_BYTES))
    return max(1, -(-(tokens.agg(F.sum(size)).first()[0] or 0) // target_bytes))


def write(tokens: DataFrame, path: str, splits: DataFrame | None = None, shards: int | None = None, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Writes tokens(subject_id, idx, ...) to path and returns its index.

    A subject stays whole, however long. Without splits(subject_id, split) the split is null;
    subjects that they lack have <missing>, and those they name twice are an error."""
    n = shards or shard_count(tokens, target_bytes)
    rows = tokens.withColumn("shard", shard_of(F.col("subject_id"), n)).repartition(n, "shard").sortWithinPartitions("shard", "subject_id", "idx")
    rows.write.mode("overwrite").partitionBy("shard").parquet(f"{path}/timelines")
    spark = tokens.sparkSession
    held = spark.read.parquet(f"{path}/timelines")
    rel = F.concat(F.lit("timelines/"), F.regexp_extract(F.col("_metadata.file_path"), "/timelines/(.*)$", 1))
    index = held.select("subject_id", "shard", rel.alias("rel_path")).groupBy("subject_id", "shard", "rel_path").agg(F.count("*").alias("n"))
    index = index.withColumn("subject_idx", F.row_number().over(W.partitionBy("shard").orderBy("subject_id")).cast("long") - 1)
    if splits is None:
        index = index.withColumn("split", F.lit(None).cast("string"))
    else:
        twice = F.raise_error(F.concat(F.lit("subject in two rows: "), F.col("subject_id").cast("string")))
        one = splits.groupBy("subject_id").agg(F.when(F.count("*") > 1, twice).otherwise(F.min("split")).cast("string").alias("split"))
        index = index.join(one, "subject_id", "left").withColumn("split", F.coalesce("split", F.lit("<missing>")))
    index.select("subject_id", "shard", "rel_path", "subject_idx", "n", "split").repartitionByRange("subject_id").sortWithinPartitions("subject_id").write.mode("overwrite").parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def chosen(index: DataFrame, split: str, splits: DataFrame | None = None, ratio: float = 0.8) -> DataFrame:
    """The index rows of a split: by splits, else by the index's own column, else (neither is
    there) train is the first share ``ratio`` of the subjects in the order of the shards and
    val the rest. val and test are other names of tuning and held_out."""
    name = OTHER_NAMES.get(split, split)
    if splits is not None:
        found = index.join(splits.where(F.col("split") == name).select("subject_id").distinct(), "subject_id", "left_semi")
    elif not index.where("split is not null").isEmpty():
        found = index.where(F.col("split") == name)
    else:
        if split not in ("train", "val"):
            raise ValueError("without splits there are train and val only")
        # places count up shard by shard: a row a shard is summed in order
        sizes = index.groupBy("shard").agg(F.count("*").alias("k"))
        before = F.coalesce(F.sum("k").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        cut = int(index.count() * ratio)
        placed = index.join(sizes.select("shard", before.alias("start")), "shard").where((F.col("start") + F.col("subject_idx") < cut) if split == "train" else (F.col("start") + F.col("subject_idx") >= cut))
        found = placed.select(*index.columns)
    if found.isEmpty():
        raise ValueError(f"no subjects in the split {split}")
    return found


def read(spark: SparkSession, path: str, split: str | None = None, splits: DataFrame | None = None, ratio: float = 0.8) -> DataFrame:
    """The tokens of a split's subjects (all without one). Only shards that hold some are
    opened: their numbers, at most as many as folders, go through the driver."""
    rows = spark.read.parquet(f"{path}/timelines")
    if split is None:
        return rows.drop("shard")
    some = chosen(spark.read.parquet(f"{path}/index"), split, splits, ratio)
    shards = [r.shard for r in some.select("shard").distinct().collect()]
    return rows.where(F.col("shard").isin(shards)).join(some.select("subject_id"), "subject_id", "left_semi").drop("shard")


def subject(spark: SparkSession, path: str, subject_id: int) -> DataFrame:
    """The tokens of one subject, from its own shard."""
    found = spark.read.parquet(f"{path}/index").where(F.col("subject_id") == subject_id).select("shard").first()
    rows = spark.read.parquet(f"{path}/timelines")
    return rows.where((F.col("shard") == (found.shard if found else -1)) & (F.col("subject_id") == subject_id)).drop("shard")
