import pytest
from pyspark.sql import functions as F

from caretrail.operators import timeline
from caretrail.sources.adapters import ordered
from caretrail.streaming import compile as S


@pytest.fixture
def events(spark):
    rows = [(s, e, 3600 * e, "LAB//1//U" if e else "HOSPITAL_ADMISSION", 1.0) for s in (1, 2, 3) for e in range(4)]
    df = spark.createDataFrame(rows, "subject_id long, event_id long, sec long, code string, numeric_value double")
    return df.select("subject_id", "event_id", F.timestamp_seconds("sec").alias("time"), (F.col("sec") * 1_000_000).alias("t_us"), "code", "numeric_value")


def shown(df):
    return sorted(map(str, df.select("subject_id", "idx", "kind", "surface", "t_us", "dt_us", "hook").collect()))


def whole(df):
    return shown(timeline.tokens(ordered(df, "event_id")))


def test_compiles_new_subjects_once(spark, events, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    events.where("subject_id = 1").write.mode("append").parquet(src)
    for _ in range(2):
        S.compile_stream(spark.readStream.schema(events.schema).parquet(src), out, ckpt, 2).awaitTermination()
        events.write.mode("append").parquet(src)  # subject 1 comes again, the others are new
    assert shown(S.compiled(spark, out)) == whole(events)
    assert sorted((r.subject_id, r.batch, r.n) for r in S.subjects(spark, out).collect()) == [(1, 0, 4), (2, 1, 4), (3, 1, 4)]


def test_a_repeated_batch_adds_nothing(spark, events, tmp_path):
    path = str(tmp_path / "out")
    S.compile_batch(events.where("subject_id = 1"), path, 2, batch=0)
    for _ in range(3):
        S.compile_batch(events, path, 2, batch=1)
        assert shown(S.compiled(spark, path)) == whole(events)
    assert S.subjects(spark, path).count() == 3


def test_a_failed_batch_is_not_seen(spark, events, tmp_path):
    path = str(tmp_path / "out")
    S.compile_batch(events.where("subject_id = 1"), path, 2, batch=0)
    S.compile_batch(events.where("subject_id > 1"), path, 2, batch=1)
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/subjects/batch=1")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)  # as if it had stopped before the list
    assert shown(S.compiled(spark, path)) == whole(events.where("subject_id = 1"))
    S.compile_batch(events.where("subject_id = 3"), path, 2, batch=1)
    assert shown(S.compiled(spark, path)) == whole(events.where("subject_id <> 2"))


def test_histories_go_on(spark, events, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    for part in ("event_id < 2", "event_id between 1 and 2 and subject_id < 3", "event_id = 3 or subject_id = 3"):
        events.where(part).write.mode("append").parquet(src)
        S.compile_stream(spark.readStream.schema(events.schema).parquet(src), out, ckpt, 2, "extend").awaitTermination()
    assert shown(S.compiled(spark, out)) == whole(events)
    S.compile_batch(events.where("event_id between 1 and 2 and subject_id < 3"), out, 2, 1, "extend")  # the second batch once more
    assert shown(S.compiled(spark, out)) == whole(events)


def test_no_events(spark, events, tmp_path):
    path = str(tmp_path / "out")
    S.compile_batch(events.limit(0), path, 2)
    assert S.subjects(spark, path).count() == 0
    with pytest.raises(ValueError):
        S.compile_batch(events, path, 2, mode="other")


def test_many_events_make_more_files_not_larger_tasks(spark, events, tmp_path, monkeypatch):
    """Few shards do not bound the tasks; each file holds whole subjects in order."""
    from caretrail.sources import adapters

    out = str(tmp_path / "out")
    more = events.crossJoin(spark.range(8).withColumnRenamed("id", "i")).withColumn("subject_id", F.col("subject_id") + 3 * F.col("i")).drop("i")
    S.compile_batch(more.where("event_id < 2"), out, 2, 0, "extend")  # few: a file a shard
    assert len(spark.read.parquet(f"{out}/timelines").inputFiles()) == 2
    monkeypatch.setattr(adapters, "TASK_EVENTS", 3)
    for _ in range(2):
        S.compile_batch(more.where("event_id >= 2"), out, 2, 1, "extend")
    rows = spark.read.parquet(f"{out}/timelines").where("batch = 1").select("subject_id", "idx", "shard", F.input_file_name().alias("f"))
    files = rows.toPandas().groupby(["shard", "f"], sort=False)
    assert len(files) > 8 and all(x[["subject_id", "idx"]].apply(tuple, axis=1).is_monotonic_increasing for _, x in files)
    assert rows.groupBy("subject_id").agg(F.count_distinct("f").alias("n")).where("n > 1").isEmpty()
    assert shown(S.compiled(spark, out)) == whole(more)
