"""Token ids of events, and residual quantisation, on small hand-made cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from caretrail import config as C
from caretrail.operators import encoding, quantise, timeline
from caretrail.plans import model_input

DATA = "/root/testdata/sf0.001"
EVENT = "subject_id long, pos long, t_us long, code string, numeric_value double, route string, dosage double"


def events(spark, *rows):
    return spark.createDataFrame([(1, i, i * 1_000_000, *r, *[None] * (4 - len(r))) for i, r in enumerate(rows)], EVENT)


def encoders(spark, m, **more):
    table = lambda rows, kind: spark.createDataFrame(rows, kind)
    numbers = table([("LAB//1//U", 1, 10.0, 2.0)], "code string, var_id long, mean double, std double")
    resolved = table([("DIAGNOSIS", "DIAGNOSIS//ICD//10//E11", "exact", 1_000_005), ("MEDICATION", "MEDICATION//START//X", "residual_hash", 1_800_007)], "category string, code string, stage string, gid long")
    return encoding.Encoders(numbers, encoding.structural_vocab(timeline.classified(m)), resolved, quantise.scalar_codes(quantise.scalar_books(2, 16, 1)), 2, 16)._replace(**more)


def run(spark, m, enc):
    t = encoding.tokens(m, encoding.dictionary(m, enc), enc)
    return t.orderBy("idx").collect()


def test_every_family(spark):
    m = events(spark, ("HOSPITAL_ADMISSION//X", None), ("LAB//1//U", 14.0), ("LAB//1//U", None), ("LAB//9//POS", 1.0), ("DIAGNOSIS//ICD//10//E11", None), ("DIAGNOSIS//ICD//10//UNSEEN", None), ("MEDICATION//START//X", 5.0), ("ADMIN//NOTE", None), (None, None))
    got = run(spark, m, encoders(spark, m))
    assert [r.kind for r in got] == ["STRUCT", "MEAS", "VALUE", "VALUE", "OBS_CODE", "OBS_VALUE", "OBS_CODE", "OBS_VALUE", "CODE", "CODE", "MARK"]
    by = {r.idx: r for r in got}
    assert by[0].gid == 2_200_001 and by[0].hook and not any(r.hook for r in got[1:])
    assert by[1].gid == 2_000_001 and by[1].value == 2.0
    assert [(by[i].level, by[i].gid // 16 * 16) for i in (2, 3)] == [(0, 2_100_000), (1, 2_100_016)]
    assert by[5].gid > 2_320_004 and 2_300_000 < by[4].gid < 2_320_000 and by[7].gid > 2_320_000
    assert by[8].gid == 1_000_005 and by[8].exact and by[9].gid == 1_800_007 and not by[9].exact
    assert by[10].gid == 1_400_000 and by[10].surface == "START" and by[10].value == by[9].value == 5.0
    # codes without a token don't move the clock
    assert [r.dt_us for r in got if r.tok_ord == 0] == [0, 1e6, 1e6, 1e6, 1e6, 2e6]


def test_boundary_keeps_a_token(spark):
    m = events(spark, ("DIAGNOSIS//ICD//10//UNSEEN", None), ("PROCEDURE//CPT//1", None), ("LAB//7", None))
    cut = spark.createDataFrame([("DIAGNOSIS//ICD//10//UNSEEN",), ("LAB//7",)], "code string")
    got = run(spark, m, encoders(spark, m, codebook=False, boundaries=cut))
    assert [(r.kind, r.gid, r.hook) for r in got[:1]] == [("UNK", 1_000_000, True)]
    assert [(r.kind, r.hook) for r in got[1:]] == [("OBS_CODE", True), ("OBS_VALUE", True)]
    plain = run(spark, events(spark, ("ED_OUT", None), ("STRUCT_START_OR", None)), encoders(spark, m, codebook=False))
    assert [r.hook for r in plain] == [True, False]


def test_vocabularies_drop_or_hash(spark):
    m = events(spark, ("LAB//7//POS", None), ("LAB//8//POS", None))
    codes = spark.createDataFrame([("LAB::7", 3)], "surface string, raw_id long")
    values = spark.createDataFrame([("POS", 9)], "surface string, raw_id long")
    got = run(spark, m, encoders(spark, m, observation_codes=codes, observation_values=values, tail="drop"))
    assert [(r.gid, r.exact) for r in got] == [(2_300_003, True), (2_320_009, True)]
    got = run(spark, m, encoders(spark, m, observation_codes=codes, observation_values=values))
    assert [r.exact for r in got] == [True, True, False, True]


def test_process_pair_and_attributes(spark):
    m = events(spark, ("MEDICATION//START//X", 5.0, "PO", 400.0), ("LAB//1//U", 1.0))
    more = {"process": True, "attributes": {"route": {"PO": 2}}, "numbers": ("dosage",)}
    got = run(spark, m, encoders(spark, m, **more))
    assert [r.kind for r in got[:4]] == ["PROCESS_ACTION", "PROCESS_ENTITY", "CODE", "MARK"]
    assert got[0].gid == C.PROCESS_ACTION_OFFSET + 1 and got[0].cat_attrs == {"route": 2} and got[0].num_attrs == {"dosage": 1.0} and got[4].cat_attrs is None
    got = run(spark, m, encoders(spark, m, process=True, keep_process_codes=False))
    assert [r.kind for r in got[:3]] == ["PROCESS_ACTION", "PROCESS_ENTITY", "MEAS"]


def test_carved_offsets():
    at = {"diagnosis": 1_000_000, "procedure": 1_200_000, "medication": 1_400_000, "structural": 2_200_000}
    assert encoding.carved(at, {"diagnosis": 99, "procedure": 170_000}, 40_000) == {"diagnosis": 1_001_099, "procedure": None, "medication": 1_401_000}
    assert encoding.carved(at, {"diagnosis": 159_000}, 40_000)["diagnosis"] is None
    assert encoding.carved(at, {"diagnosis": 158_999}, 40_000)["diagnosis"] == 1_159_999


def test_ids_cost_no_further_shuffle(spark):
    plan = model_input.encoded(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange" in line for line in plan.splitlines()) <= 3


def test_nearest_codes_are_exact():
    rng = np.random.default_rng(4)
    book = rng.normal(size=(50, 6))
    book[7] = book[3]
    x = np.vstack([rng.normal(size=(3000, 6)), book, (book[:25] + book[25:]) / 2, np.full((1, 6), 1e8)])
    want = ((x[:, None] - book) ** 2).sum(2).argmin(1)
    assert (quantise.nearest(x, book) == want).all()


def test_codes_of_vectors(spark):
    rng = np.random.default_rng(5)
    stack = [rng.normal(size=(9, 4)), rng.normal(size=(5, 4)) / 3]
    table = spark.createDataFrame([(i, k, v.tolist()) for i, b in enumerate(stack) for k, v in enumerate(b)], "level int, code int, vector array<double>")
    got = quantise.books(table)
    assert all((a == b).all() for a, b in zip(got, stack))
    rows = [(i, rng.normal(size=4).tolist()) for i in range(40)] + [(90, None), (91, [1.0]), (92, [None, 1.0, 1.0, 1.0]), (93, [float("inf")] * 4)]
    out = spark.createDataFrame(rows, "i int, v array<double>").withColumn("c", quantise.codes(F.col("v"), got)).withColumn("back", quantise.restored(F.col("c"), got)).collect()
    for r in out:
        if r.i >= 90:
            assert r.c is None and r.back is None
            continue
        rest, want = np.array(r.v), []
        for b in stack:
            want.append(int(((rest - b) ** 2).sum(1).argmin()))
            rest = rest - b[want[-1]]
        assert r.c == want and np.allclose(np.array(r.v) - r.back, rest)
    with pytest.raises(ValueError):
        quantise.books(table.where("code <> 1"))
