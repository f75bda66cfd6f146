"""Registered queries against their SQL twins on the smallest shared tables."""

import os

import pandas as pd
import pytest

import __spark_entry__ as entry
from caretrail.operators import vocab
from caretrail.plans import queries as core

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SOME = ["route_category", "decode_items", "dense_round_trip", "audit_bundles", "audit_windows", "audit_counters", "trajectory_timelines", "matching_report", "shard_index", "incremental_timelines", "timeline_by_rules", "full_targets", "residual_vocab", "lookup_problems", "csr_roundtrip", "timeline_ids", "chunk_sequences", "chunk_sequences_next_type", "sequence_overflow", "resolve_ids", "canon_proc", "transition_rules", "var_stats", "canon_med", "surfaces", "vocab_hits", "obs_vocab", "decision_table", "raw_summary", "timeline_tokens", "merged_bundles", "windows", "policy_percentiles", "remap_ids", "pack_rvq", "resolve_cascade", "resolve_known", "resolve_unk", "chunks", "trajectories", "trajectory_clock", "rebalanced"]


def plain(df):
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return None
        return f"{float(v):.7g}" if isinstance(v, float) or hasattr(v, "__index__") else str(v)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted([tuple(map(cell, r)) for r in df.itertuples(index=False)], key=str)


@pytest.fixture(scope="module")
def db():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the shared tables are not there")
@pytest.mark.parametrize("name", SOME)
def test_twin(spark, db, name):
    assert plain(core.QUERIES[name](spark, DATA).toPandas()) == plain(db.sql(core.ORACLES[name]).df())


def test_registry():
    assert {*core.ORACLES} <= {*core.QUERIES} and {*core.QUERIES} <= {*entry.queries()}
    assert {*entry.oracle_sql()} <= {*entry.queries()}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the shared tables are not there")
def test_resolution_stages(spark):
    stages = {r.stage for r in core.resolve_cascade(spark, DATA).select("stage").distinct().collect()}
    assert stages == {*vocab.STAGES}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the shared tables are not there")
@pytest.mark.parametrize("name, most", [("windows", 3), ("chunks", 3), ("trajectories", 3), ("trajectory_clock", 3)])
def test_segmentation_stays_on_one_partitioning(spark, name, most):
    plan = core.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange" in line for line in plan.splitlines()) <= most


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the shared tables are not there")
@pytest.mark.parametrize("name, most", [("timeline_ids", 3), ("chunk_sequences", 4), ("sequence_overflow", 6)])
def test_model_input_stays_on_one_partitioning(spark, name, most):
    plan = core.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange" in line for line in plan.splitlines()) <= most


def _twin_of(spark, db_tables, name, d):
    import duckdb

    con = duckdb.connect()
    for t in db_tables:
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    return plain(core.QUERIES[name](spark, str(d)).toPandas()), plain(con.sql(core.ORACLES[name]).df())


def test_rebalanced_where_its_target_decides(spark, tmp_path):
    """Twenty-five groups of one token and then more: the chunk is full at 25, not at 26."""
    rows = "select id as event_id, timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, cast(id as int)) as ts, cast(1 as long) as user_id, 'view' as event_type, 1.0d as value, '{\"k\": 3}' as props from range(40)"
    spark.sql(rows).write.parquet(f"{tmp_path}/events.parquet")
    got, want = _twin_of(spark, ["events"], "rebalanced", tmp_path)
    assert got == want and len(got[1]) == 2


def test_blocks_of_large_part_keys(spark, tmp_path):
    """Ids before the first family or from the last one's end on count nowhere."""
    spark.sql("select cast(k as long) as l_partkey, 1 as l_linenumber from values (-5), (1), (900), (1900), (800000), (1200000) as t(k)").write.parquet(f"{tmp_path}/lineitem.parquet")
    got, want = _twin_of(spark, ["lineitem"], "runtime_blocks", tmp_path)
    assert got == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the shared tables are not there")
def test_partitions_of_timelines_follow_the_number_of_events(spark, db, monkeypatch):
    """More events make more tasks, not larger ones, whatever the session coalesces; same rows."""
    from caretrail.sources import adapters

    monkeypatch.setattr(adapters, "TASK_EVENTS", 20)
    n = db.sql("select count(*) from events").fetchall()[0][0]
    made = core.QUERIES["windows"](spark, DATA)
    made = core.QUERIES["windows"](spark, DATA)
    assert made.rdd.getNumPartitions() == -(-n // 20) >= 16
    assert plain(made.toPandas()) == plain(db.sql(core.ORACLES["windows"]).df())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the shared tables are not there")
@pytest.mark.parametrize("name", ["timeline_ids", "decode_items", "audit_windows", "chunk_sequences"])
def test_partitions_of_timelines_with_ids_follow_the_number_of_events(spark, db, monkeypatch, name):
    """Neither value ids nor names deal the events anew: no exchange that the session coalesces."""
    from caretrail.sources import adapters

    monkeypatch.setattr(adapters, "TASK_EVENTS", 20)
    n = db.sql("select count(*) from events").fetchall()[0][0]
    assert core.QUERIES[name](spark, DATA).rdd.getNumPartitions() == -(-n // 20) >= 16


def test_a_filter_on_a_rule_does_not_test_events_with_the_rules(spark):
    """Rules are evaluated for each distinct code, also where only some categories are asked for."""
    from caretrail.operators import timeline

    events = spark.sql("select concat('LAB//', id % 3) as code, cast(id as double) as numeric_value from range(20)")
    some = timeline.classified(events).where("category = 'MEASUREMENT'").groupBy("code").count()
    tests = [line for line in some._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line]
    assert tests and not [line for line in tests if "RLIKE" in line]
    assert sorted(map(tuple, some.collect())) == [("LAB//0", 7), ("LAB//1", 7), ("LAB//2", 6)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the shared tables are not there")
def test_partitions_of_specials_follow_the_number_of_events(spark, monkeypatch):
    """Histories with their static rows are dealt like timelines, not coalesced; same rows."""
    from caretrail.sources import adapters

    want = plain(core.specials(spark, DATA).toPandas())
    monkeypatch.setattr(adapters, "TASK_EVENTS", 20)
    # as at size, where no side of these joins is small
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = core.specials(spark, DATA)
        assert made.rdd.getNumPartitions() == -(-adapters.size(spark, DATA) // 20) >= 16
        assert plain(made.toPandas()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
