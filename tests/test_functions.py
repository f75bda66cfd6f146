"""Scalars over codes and numbers, case by case."""

from pyspark.sql import functions as F

from caretrail.functions import numeric as N
from caretrail.functions import routing as R
from caretrail.functions import text as T


def values(spark, f, *codes):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i int, c string")
    return [r.v for r in df.select("i", f(F.col("c")).alias("v")).orderBy("i").collect()]


def test_category(spark):
    cases = {
        " lab//50912//mg/dl ": "MEASUREMENT", "VITAL//HR": "MEASUREMENT", "Blood Pressure": "MEASUREMENT", "X//BLOOD PRESSURE": "MEASUREMENT", "BMI (kg/m2)": "OTHER",
        "Event//Code Blue": "STRUCTURAL", "LAB//CPR": "MEASUREMENT", "RXNORM//1": "MEDICATION", "INFUSION_START//2": "MEDICATION", "HCPCS//A": "PROCEDURE", "ICD10PCS//0": "PROCEDURE",
        "ICD10CM//A": "DIAGNOSIS", "ICD//x": "DIAGNOSIS", "TRANSFER_TO//ED": "STRUCTURAL", "": "OTHER", "GENDER//M": "OTHER", None: "OTHER",
    }
    assert values(spark, R.category, *cases) == list(cases.values())


def test_window_types_and_sites(spark):
    codes = ("TRANSFER_TO//ED//Emergency Department", "TRANSFER_TO//transfer//PACU", "TRANSFER_TO//admit//Medical Intensive Care Unit (MICU)", "ED_REGISTRATION", "STRUCT_START_OR", "TRANSFER_TO//x//OPERATING ROOM", "LAB//1", None)
    assert values(spark, R.window_type, *codes) == ["ED_ADMISSION", "INPATIENT", "ICU", "ED_ADMISSION", "OR", "OR", None, None]
    sites = values(spark, lambda c: R.site_name(c, R.window_type(c)), *codes)
    assert sites == ["ED_ADMISSION::ED", "INPATIENT::PACU", "ICU::MICU", "ED_ADMISSION::ED", "OR::OR", "OR::X OPERATING ROOM", None, None]


def test_candidates(spark):
    assert values(spark, T.diagnosis_candidates, "dx A12.3")[0][:2] == ["ICD10CM//A12.3", "ICD10CM//A123"]
    assert values(spark, T.diagnosis_candidates, "DIAGNOSIS//ICD//9//V5867", "nothing", None)[0][0] == "ICD10CM//V5867"
    assert values(spark, T.diagnosis_candidates, "nothing", None) == [[], []]
    assert values(spark, T.procedure_candidates, "PROCEDURE//CPT//99213", None) == [["CPT//99213", "99213"], []]
    assert values(spark, T.ndc, "0002-1200-80") == ["00000002120080"]
    assert values(spark, T.medication_candidates, "MEDICATION//Aspirin  81//Administered")[0] == ["MEDICATION//ASPIRIN 81", "MEDICATION//ASPIRIN 81//ADMINISTERED", "ASPIRIN 81", "MEDICATION//Aspirin  81//Administered"]


def test_observations(spark):
    assert values(spark, T.observed_value, None, "  ", "unknown", "n/a", "null", " A  b ", "x" * 120) == ["UNK", "UNK", "UNK", "N/A", "NONE", "A b", "x" * 96]
    assert values(spark, T.observation_surface, "LAB//1//x", "lab", "OTHER//1", None) == ["LAB::1", "LAB::lab", None, None]


def test_markers(spark):
    codes = ("MEDICATION//START//DRUG 1", "INFUSION_END//22", "PROCEDURE//Stop//x", "LAB//1")
    assert values(spark, R.marker, *codes) == ["START", "END", "STOP", None]
    assert values(spark, R.unmarked, *codes) == ["MEDICATION//DRUG 1", "INFUSION//22", "PROCEDURE//x", "LAB//1"]


def test_numbers(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (0.0,), (1.0,), (400.0,), (9e9,)], "x double")
    assert [r[0] for r in df.select(N.bin_id(F.col("x"), "dosage")).collect()] == [0, 0, 1, 1, 4, 4]
    df = spark.createDataFrame([([],), ([1.0, 2.0, 3.0, 4.0],), ([5.0],)], "v array<double>")
    assert [r[0] for r in df.select(N.nearest_rank(F.col("v"), 0.5)).collect()] == [0.0, 3.0, 5.0]
    df = spark.createDataFrame([([3, 250],)], "v array<bigint>")
    assert df.select(N.unpack(N.pack(F.col("v"), 256), 256, 2)).first()[0] == [3, 250]
    df = spark.createDataFrame([([*range(1, 8), 100],), ([255] * 7 + [127],)], "v array<bigint>")
    assert [r[0] for r in df.select(N.unpack(N.pack(F.col("v"), 256), 256, 8)).collect()] == [[*range(1, 8), 100], [255] * 7 + [127]]
