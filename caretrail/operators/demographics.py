"""Summary tokens of a subject, from what is known at its first admission.

Fixed values: the ids of demographic tokens, and unit factors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import numeric as N
from ..functions import routing as R
from .timeline import anchors, as_of

SEX_F, SEX_M, AGE_FIRST, BMI_FIRST, HEIGHT, WEIGHT = 30, 31, 32, 37, 43, 44
CM_PER_INCH, KG_PER_LB, BMI_FACTOR = 2.54, 0.45359237, 703.0
YEAR_US = 31_557_600_000_000


def known_at(events: DataFrame, anchor: DataFrame) -> DataFrame:
    """subject_id, sex (1 male), birth_us, bmi, weight (lb) and height (in) as of
    anchor(subject_id, anchor_us); the body mass index from the other two if absent."""
    c = R.normal(F.col("code"))
    sex = F.when(c == "GENDER//M", 1.0).when(c == "GENDER//F", 0.0)
    causal = F.col("t_us").isNull() | (F.col("t_us") <= F.col("anchor_us"))
    static = events.join(anchor, "subject_id").groupBy("subject_id").agg(F.min_by(sex, F.when(sex.isNotNull() & causal, F.col("pos"))).alias("sex"), F.min_by("t_us", F.when(F.col("code") == "MEDS_BIRTH", F.col("pos"))).alias("birth_us"))
    out = anchor.join(static, "subject_id", "left")
    for name, alias in (("bmi", "BMI (KG/M2)"), ("weight", "WEIGHT (LBS)"), ("height", "HEIGHT (INCHES)")):
        out = out.join(as_of(events, (alias,), anchor).select("subject_id", F.col("value").alias(name)), "subject_id", "left")
    ratio = F.when(F.col("height") > 0, F.col("weight") * BMI_FACTOR / (F.col("height") * F.col("height")))
    return out.withColumn("bmi", F.coalesce("bmi", ratio))


def summary_tokens(events: DataFrame, anchor: DataFrame | None = None) -> DataFrame:
    """subject_id, ord, token_id and value: sex, age, body mass, height, weight."""
    k = known_at(events, anchors(events) if anchor is None else anchor)
    age = (F.col("anchor_us") - F.col("birth_us")) / YEAR_US
    none = F.lit(None).cast("double")
    token = lambda test, i, v: F.when(test, F.struct(i.cast("int").alias("token_id"), v.alias("value")))
    rows = F.array_compact(F.array(
        token(F.col("sex").isNotNull(), F.when(F.col("sex") >= 0.5, SEX_M).otherwise(SEX_F), none),
        token(age >= 0, AGE_FIRST + N.step(age, C.DEMOGRAPHIC_AGE), none),
        token(F.col("bmi") > 0, BMI_FIRST + N.step(F.col("bmi"), C.DEMOGRAPHIC_BMI), none),
        token(F.col("height") > 0, F.lit(HEIGHT), F.col("height") * CM_PER_INCH),
        token(F.col("weight") > 0, F.lit(WEIGHT), F.col("weight") * KG_PER_LB),
    ))
    return k.select("subject_id", F.posexplode(rows).alias("ord", "t")).select("subject_id", F.col("ord").cast("long").alias("ord"), "t.token_id", "t.value")
