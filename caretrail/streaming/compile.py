"""Incremental compilation: histories are compiled as their events arrive.

An addition to the batch operators: Structured Streaming keeps track of what was read, and
each micro-batch is compiled by the same plan as a batch run. Everything a batch writes lies
in folders of its own number, and its subjects are listed last. So a batch that is repeated,
after a failure at any point, replaces what it had written and nothing else, and what a failed
batch left behind is not seen.

    events/batch=<id>     the batch's events, where histories may go on later
    timelines/batch=<id>  the tokens of its subjects, by shard
    subjects/batch=<id>   the subjects, with their number of tokens: the batch is complete
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.timeline import tokens
from ..sources.adapters import dealt, many, ordered

EVENTS = "subject_id long, event_id long, time timestamp, t_us long, code string, numeric_value double"
MODES = ("once", "extend")


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def subjects(spark: SparkSession, path: str) -> DataFrame:
    """subject_id, n and batch of every complete batch."""
    schema = "subject_id long, n long, batch long"
    if not _exists(spark, f"{path}/subjects"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/subjects")


def compile_batch(events: DataFrame, path: str, shards: int, batch: int = 0, mode: str = "once") -> None:
    """Compiles events(EVENTS) as the batch of that number.

    once: a subject's events come in one batch; those of subjects that another batch holds
    are left out. extend: histories go on; the batch's events are kept, and the timelines of
    its subjects are made anew of all their events up to this batch. Events that repeat
    subject and event_id count once. The subject index is read, not the timelines.

    Where events are many they are dealt by subject, and a task writes its subjects' part of
    each shard; else a shard is one file."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    spark = events.sparkSession
    events = events.select("subject_id", "event_id", "time", "t_us", "code", "numeric_value")
    if mode == "extend":
        events.write.mode("overwrite").parquet(f"{path}/events/batch={batch}")
        held = spark.read.schema(f"{EVENTS}, batch long").parquet(f"{path}/events").where(F.col("batch") <= batch)
        touched = held.where(F.col("batch") == batch).select("subject_id").distinct()
        n = held.count()  # stands in the files' footers
        events = dealt(held, n).join(touched, "subject_id", "left_semi").drop("batch").dropDuplicates(["subject_id", "event_id"])
    else:
        known = subjects(spark, path).where(F.col("batch") != batch).select("subject_id")
        n = events.count()
        events = dealt(events, n).join(known, "subject_id", "left_anti")
    own = f"{path}/timelines/batch={batch}"
    rows = tokens(ordered(events, "event_id")).withColumn("shard", F.pmod(F.xxhash64("subject_id"), F.lit(shards)))
    rows = rows if many(n) else rows.repartition(shards, "shard")
    rows.sortWithinPartitions("shard", "subject_id", "idx").write.mode("overwrite").partitionBy("shard").parquet(own)
    done = spark.read.schema(rows.schema).parquet(own).groupBy("subject_id").agg(F.count("*").alias("n"))
    done.write.mode("overwrite").parquet(f"{path}/subjects/batch={batch}")


def compiled(spark: SparkSession, path: str) -> DataFrame:
    """The tokens of every subject, as of the last complete batch that holds it."""
    rows = spark.read.parquet(f"{path}/timelines").withColumn("batch", F.col("batch").cast("long"))
    last = subjects(spark, path).groupBy("subject_id").agg(F.max("batch").alias("last"))
    # by subject alone: dealt rows stay as they are; what was replaced is left out then
    return dealt(rows, rows.count()).join(last, "subject_id").where(F.col("batch") == F.col("last")).drop("batch", "last", "shard")


def compile_stream(events: DataFrame, path: str, checkpoint: str, shards: int = 16, mode: str = "once") -> StreamingQuery:
    """Starts compiling a stream of events(EVENTS) into path; see ``compile_batch``."""
    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, batch: compile_batch(df, path, shards, batch, mode)).start()
