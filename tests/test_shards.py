import pytest
from pyspark.sql import functions as F

from caretrail.operators import vocab
from caretrail.sources import shards as S


@pytest.fixture(scope="module")
def tokens(spark):
    return spark.range(60).select(F.expr("id div 3").alias("subject_id"), (F.col("id") % 3).alias("idx"), F.concat(F.lit("code "), F.col("id")).alias("surface"))


def shown(df):
    return sorted(map(tuple, df.select("subject_id", "idx", "surface").collect()))


def test_round_trip_and_index(spark, tokens, tmp_path):
    path = str(tmp_path / "s")
    index = S.write(tokens, path, shards=4).collect()
    assert shown(S.read(spark, path)) == shown(tokens)
    assert sorted(r.subject_id for r in index) == list(range(20)) and {r.n for r in index} == {3} and {r.split for r in index} == {None}
    for r in index:
        assert r.rel_path.startswith(f"timelines/shard={r.shard}/part-")
        held = [x.subject_id for x in spark.read.parquet(f"{path}/{r.rel_path}").select("subject_id").distinct().orderBy("subject_id").collect()]
        assert held[r.subject_idx] == r.subject_id


def test_one_subject_opens_one_shard(spark, tokens, tmp_path):
    path = str(tmp_path / "s")
    S.write(tokens, path, shards=4)
    one = S.subject(spark, path, 7)
    assert [r.idx for r in one.orderBy("idx").collect()] == [0, 1, 2]
    assert one.select(F.col("_metadata.file_path")).distinct().count() == 1 if "_metadata" in one.columns else True
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan and "PushedFilters: [IsNotNull(subject_id), EqualTo(subject_id,7)]" in plan
    assert S.subject(spark, path, 99).count() == 0


def test_splits(spark, tokens, tmp_path):
    path = str(tmp_path / "s")
    splits = spark.createDataFrame([(i, "train" if i < 15 else "tuning") for i in range(19)], "subject_id long, split string")
    index = S.write(tokens, path, splits, shards=4)
    assert {r.split: r["count"] for r in index.groupBy("split").count().collect()} == {"train": 15, "tuning": 4, "<missing>": 1}
    assert {r.subject_id for r in S.read(spark, path, "val").collect()} == {15, 16, 17, 18}
    other = spark.createDataFrame([(3, "held_out")], "subject_id long, split string")
    assert {r.subject_id for r in S.read(spark, path, "test", other).collect()} == {3}
    with pytest.raises(ValueError):
        S.read(spark, path, "test")
    with pytest.raises(Exception, match="subject in two rows"):
        S.write(tokens, str(tmp_path / "t"), splits.union(splits), shards=2).collect()


def test_ratio_without_splits(spark, tokens, tmp_path):
    path = str(tmp_path / "s")
    index = S.write(tokens, path, shards=3).orderBy("shard", "subject_idx").collect()
    order = [r.subject_id for r in index]
    assert {r.subject_id for r in S.read(spark, path, "train", ratio=0.75).collect()} == set(order[:15])
    assert {r.subject_id for r in S.read(spark, path, "val", ratio=0.75).collect()} == set(order[15:])
    with pytest.raises(ValueError):
        S.read(spark, path, "tuning")


def test_shards_follow_from_bytes(spark, tokens):
    size = sum(64 + len(r.surface) for r in tokens.collect())
    assert [S.shard_count(tokens, b) for b in (size + 1, size - 1, size // 7)] == [1, 2, -(-size // (size // 7))]
    assert S.shard_count(tokens.limit(0)) == 1


def test_vocabulary_extension_like_sequential(spark):
    import random

    r = random.Random(1)
    known = [("DIAGNOSIS", f"D{i}", i) for i in range(5)] + [("MEDICATION", "M1", 7)]
    aliases = [(r.choice(["DIAGNOSIS", "PROCEDURE", "MEDICATION"]), i, [f"{r.choice('DPM')}{r.randint(0, 12)}" for _ in range(r.randint(0, 3))]) for i in range(80)]
    want = []
    for family in ("DIAGNOSIS", "PROCEDURE", "MEDICATION"):
        table = {e: i for f, e, i in known if f == family}
        following = max(table.values()) + 1 if table else 0
        for f, _, targets in aliases:
            for t in targets if f == family else []:
                if t not in table:
                    table[t] = following
                    following += 1
                break
        want += [(family, e, i) for e, i in table.items()]
    got = vocab.extended(spark.createDataFrame(known, "category string, entry string, raw_id long"), spark.createDataFrame(aliases, "category string, ord long, targets array<string>").repartition(3))
    assert sorted(map(tuple, got.collect())) == sorted(want)
