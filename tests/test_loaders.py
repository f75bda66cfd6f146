"""Vocabularies, crosswalks, rules and reports from files; aliases; checks that raise."""

import json

import pytest
from pyspark.sql import functions as F

from caretrail import config as C
from caretrail.functions import text as T
from caretrail.operators import audit, collate
from caretrail.sources import adapters as A
from caretrail.sources import loaders as L

from .test_functions import values


def written(path, body):
    path.write_text(body if isinstance(body, str) else json.dumps(body))
    return str(path)


def test_vocabularies(spark, tmp_path):
    fp = written(tmp_path / "v.json", {"<UNK>": 0, "ICD10CM//A1": 7})
    got = {(r.category, r.entry, r.raw_id) for r in L.vocabulary(spark, fp, "DIAGNOSIS").collect()}
    assert got == {("DIAGNOSIS", "<UNK>", 0), ("DIAGNOSIS", "ICD10CM//A1", 7)}
    assert L.vocabulary(spark, str(tmp_path / "none.json"), "DIAGNOSIS", optional=True) is None
    with pytest.raises(FileNotFoundError):
        L.vocabulary(spark, None, "DIAGNOSIS")
    assert L.first_of(spark, str(tmp_path / "none.json"), fp) == fp and L.first_of(spark, str(tmp_path / "x")) is None
    fp = written(tmp_path / "e.json", {"a": [1, 2.5], "b": []})
    assert {r.code: r.vector for r in L.embeddings(spark, fp).collect()} == {"a": [1.0, 2.5], "b": []}


def test_parents(spark):
    rows = [("a", "['X', ' Y ', 'X', '']"), ("b", "plain"), ("c", None), ("d", "  "), (None, "Z"), ("e", "[broken")]
    got = {(r.key, r.parent) for r in L.parents(spark.createDataFrame(rows, "code string, parent_codes string"), "MEDICATION").collect()}
    assert got == {("A", "X"), ("A", "Y"), ("B", "plain"), ("E", "[broken")}
    lists = spark.createDataFrame([("a", ["X", None, " Y"]), ("b", None)], "code string, parent_codes array<string>")
    assert {(r.key, r.parent) for r in L.parents(lists, "MEDICATION").collect()} == {("A", "X"), ("A", "Y")}


def test_crosswalks(spark, tmp_path):
    body = {"families": {"medication": {"aliases": {" aspirin": "RXNORM//1", "IBU": ["RXNORM//2", "2", "RXNORM//2", " "], "": "x"}}}}
    rows = L.crosswalk_targets(spark, written(tmp_path / "c.json", body), "MEDICATION").collect()
    assert {(r.key, r.place, r.target) for r in rows} == {("ASPIRIN", 0, "RXNORM//1"), ("IBU", 0, "RXNORM//2"), ("IBU", 1, "2")}
    fp = written(tmp_path / "m.csv", 'label,omop_concept_name,omop_concept_code,omop_vocabulary_id\n"Drug, oral",drug,161,RxNorm\n,x,1,RxNorm\nCut,cut,12.3,ICD9Proc\nNo,no,1,Other\n')
    rows = L.concept_map(L.concept_file(spark, fp), "MEDICATION").collect()
    assert {(r.label, tuple(r.targets), r.semantic_id) for r in rows} == {("Drug, oral", ("161", "RXNORM//161"), "RxNorm:161"), ("Cut", ("ICD9PROC//12.3", "12.3", "123"), "ICD9Proc:12.3")}


def test_decision_tables(spark, tmp_path):
    fp = written(tmp_path / "d.csv", "code,events_total,note\nA,5,x\nB,,y\nC,many,z\n")
    got = {r.code: (r.events_total, r.suggested_action, r.numeric_rate) for r in L.decisions(spark, fp).collect()}
    assert got == {"A": (5.0, "", 0.0), "B": (0.0, "", 0.0), "C": (0.0, "", 0.0)}


def test_rules(tmp_path):
    rules = L.rules(written(tmp_path / "r.json", {"labels": {"X": "STRUCT_START_X"}, "other": 1}))
    assert rules["labels"] == {"X": "STRUCT_START_X"} and rules["transitions"] == C.TRANSITIONS
    for bad in ({"labels": {"X": 1}}, {"transitions": {"X": "jump"}}, {"types": {"X": "SPACE"}}):
        with pytest.raises(ValueError):
            L.rules(written(tmp_path / "b.json", bad))


def test_rules_are_used(spark, tmp_path):
    from caretrail.operators import timeline

    rules = L.rules(written(tmp_path / "r.json", {"labels": {"LAB//1": "X", "LAB//2": "Y", "LAB//3": "Z"}, "transitions": {"X": "open_next"}, "types": {"X": "OR"}, "boundaries": ["X"], "only": ["LAB//1", "LAB//2"], "keep": ["LAB//2"]}))
    m = spark.createDataFrame([(1, i, i, c, 1.0) for i, c in enumerate(["LAB//1", "LAB//2", "LAB//3", "LAB//4", "HOSPITAL_ADMISSION"])], "subject_id long, pos long, t_us long, code string, numeric_value double")
    got = timeline.tokens(m, rules).orderBy("idx").collect()
    assert [(r.kind, r.surface, r.hook, r.type_id) for r in got] == [("STRUCT", "LAB//1", True, 4), ("STRUCT", "LAB//2", False, None), ("MEAS", "LAB//2", False, None), ("STRUCT", "LAB//3", False, None), ("MEAS", "LAB//3", False, None), ("MEAS", "LAB//4", False, None), ("STRUCT", "HOSPITAL_ADMISSION", False, None)]
    with pytest.raises(ValueError):
        L.rules(written(tmp_path / "b.json", {"boundaries": "X"}))


def test_last_parent_row_counts(spark):
    rows = spark.createDataFrame([("a", "P1"), ("b", "P2"), ("A", "['P3', 'P4']")], "code string, parent_codes string").coalesce(1)
    assert sorted((r.key, r.parent) for r in L.parents(rows, "MEDICATION").collect()) == [("A", "P3"), ("A", "P4"), ("B", "P2")]


def test_aliases(spark):
    assert values(spark, T.procedure_aliases, "PROCEDURE//START//CT scan (head)", "x", " ") == [["PROCEDURE//START//CT scan (head)", "START//CT scan (head)", "CT scan (head)", "head", "PROCEDURE//START//CT scan", "START//CT scan", "CT scan"], ["x"], []]
    got = values(spark, T.medication_aliases, "MEDICATION//Aspirin (Bayer) 81MG tablet//Administered")[0]
    assert got[:3] == ["MEDICATION//Aspirin (Bayer) 81MG tablet//Administered", "ASPIRIN (BAYER) 81MG TABLET", "MEDICATION//ASPIRIN (BAYER) 81MG TABLET"]
    assert "ASPIRIN BAYER" in got and "BAYER" in got
    assert values(spark, T.simplified, "Heparin 5000 units IV flush", "IV 12") == ["HEPARIN UNITS", None]


def test_samples_and_splits(spark):
    s = spark.range(20).withColumnRenamed("id", "subject_id")
    assert [r[0] for r in A.chosen(s, 3, "first").collect()] == [0, 1, 2]
    assert A.chosen(s, 5, "random", 1).collect() == A.chosen(s, 5, "random", 1).collect()
    with pytest.raises(ValueError):
        A.chosen(s, 5, "best")
    assert {r[0] for r in A.listed(" 3, 4,,4", spark).collect()} == {3, 4}
    table = A.splits(s)
    assert A.of_split(s, table, "val").count() == 2
    with pytest.raises(ValueError):
        A.of_split(s, table, "nothing")
    assert audit.unique_subjects(table).count() == 20
    with pytest.raises(Exception, match="subject in two rows"):
        audit.unique_subjects(table.union(table.limit(1))).collect()


def test_maps_end_to_end(spark, tmp_path):
    rows = [(1, 0, {"b": 2, "a": 1}), (1, 1, {}), (1, 2, {"a": 5}), (2, 0, {})]
    df = spark.createDataFrame(rows, "subject_id long, idx long, attrs map<string,bigint>")
    packed = {r.subject_id: (r.offsets, r["keys"], r["values"]) for r in collate.csr(df).collect()}
    assert packed == {1: ([0, 2, 2, 3], ["a", "b", "a"], [1, 2, 5]), 2: ([0, 0], [], [])}
    assert {(r.subject_id, r.idx): r.attrs for r in collate.uncsr(collate.csr(df)).collect()} == {(s, i): m for s, i, m in rows}
    t = spark.createDataFrame([(s, s % 3, i) for s in range(5) for i in range(4)], "subject_id long, trajectory_ord int, idx long")
    collate.write_trajectories(t, str(tmp_path / "t"), 2)
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 20 and {(r.trajectory_id, r.shard) for r in back.select("trajectory_id", "shard").collect()} == {(i, i // 2) for i in range(5)}


def test_chunk_markers(spark):
    rows = spark.createDataFrame([(False, 3), (True, 3), (True, None), (True, 99)], "last boolean, n int")
    got = [(r.a, r.b) for r in rows.select(collate.chunk_suffix(F.col("last"), F.col("n")).alias("a"), collate.chunk_suffix(F.col("last"), F.col("n"), "next_type").alias("b")).collect()]
    assert got == [(18, 18), (17, 13), (17, 17), (17, 10)]
    assert [r[0] for r in spark.range(1).select(collate.content_budget(128, F.lit(3)), F.lit(0)).collect()] == [123]
