"""Trajectories as histories of their own: specials anew, first token typed, clock rebased."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config as C
from ..functions import numeric as N
from ..functions import routing as R
from . import segments
from .demographics import AGE_FIRST, BMI_FIRST, CM_PER_INCH, HEIGHT, KG_PER_LB, SEX_F, SEX_M, WEIGHT, YEAR_US

KINDS = {"bmi": ("BMI (KG/M2)", 1.0), "weight_kg": ("WEIGHT (LBS)", KG_PER_LB), "height_cm": ("HEIGHT (INCHES)", CM_PER_INCH)}


def split_specials(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The special tokens of a timeline, and the others."""
    special = F.coalesce(F.col("category") == "SPECIAL", F.lit(False))
    return tokens.where(special), tokens.where(~special)


def known_at(events: DataFrame, anchors: DataFrame) -> DataFrame:
    """anchors(subject_id, trajectory_ord, anchor_us) with sex (0 if none is told anywhere),
    birth_us, and bmi, weight_kg and height_cm as last measured at or before the anchor.

    Measurements and anchors are put in one order of time, so a subject with many of both
    costs their sum."""
    c = R.normal(F.col("code"))
    value = {n: F.when(R.matches_alias(c, (alias,)) & N.finite(F.col("numeric_value")), F.col("numeric_value") * f) for n, (alias, f) in KINDS.items()}
    told = F.when(c == "GENDER//M", 1.0).when(c == "GENDER//F", 0.0)
    none = lambda t: F.lit(None).cast(t)
    rows = events.select("subject_id", none("int").alias("trajectory_ord"), "t_us", "pos", told.alias("told"), F.when(F.col("code") == "MEDS_BIRTH", F.col("t_us")).alias("born"), *[v.alias(n) for n, v in value.items()])
    useful = F.col("told").isNotNull() | F.col("born").isNotNull() | F.coalesce(*KINDS).isNotNull()
    both = rows.where(useful).unionByName(anchors.select("subject_id", "trajectory_ord", F.col("anchor_us").alias("t_us"), none("long").alias("pos"), none("double").alias("told"), none("long").alias("born"), *[none("double").alias(n) for n in KINDS]))
    # measurements of the anchor's own time go before it; those without time are never known
    order = (F.asc_nulls_first("t_us"), F.asc_nulls_last("pos"), F.asc_nulls_last("trajectory_ord"))
    so_far = W.partitionBy("subject_id").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("subject_id")
    timed = lambda n: F.last(F.when(F.col("t_us").isNotNull(), F.col(n)), ignorenulls=True).over(so_far)
    first = lambda n: F.min_by(n, F.when(F.col(n).isNotNull(), F.col("pos"))).over(whole)
    out = both.withColumns({"sex": F.coalesce(first("told"), F.lit(0.0)), "birth_us": first("born"), **{n: timed(n) for n in KINDS}})
    return out.where(F.col("trajectory_ord").isNotNull()).select("subject_id", "trajectory_ord", F.col("t_us").alias("anchor_us"), "sex", "birth_us", *KINDS)


def specials(events: DataFrame, anchors: DataFrame) -> DataFrame:
    """subject_id, trajectory_ord, ord, token_id and value: sex, age, body mass (from weight and
    height if it was not measured), height and weight as known at each trajectory's anchor."""
    k = known_at(events, anchors)
    metres = F.col("height_cm") / 100.0
    k = k.withColumn("bmi", F.coalesce("bmi", F.when(F.col("height_cm") > 0, F.col("weight_kg") / (metres * metres))))
    age = (F.col("anchor_us") - F.col("birth_us")) / YEAR_US
    none = F.lit(None).cast("double")
    token = lambda test, i, v: F.when(test, F.struct(i.cast("int").alias("token_id"), v.alias("value")))
    rows = F.array_compact(F.array(
        token(F.col("sex").isNotNull(), F.when(F.col("sex") >= 0.5, SEX_M).otherwise(SEX_F), none), token(age >= 0, AGE_FIRST + N.step(age, C.DEMOGRAPHIC_AGE), none),
        token(F.col("bmi") > 0, BMI_FIRST + N.step(F.col("bmi"), C.DEMOGRAPHIC_BMI), none), token(F.col("height_cm") > 0, F.lit(HEIGHT), F.col("height_cm")), token(F.col("weight_kg") > 0, F.lit(WEIGHT), F.col("weight_kg")),
    ))
    out = k.select("subject_id", "trajectory_ord", F.posexplode(rows).alias("ord", "t"))
    return out.select("subject_id", "trajectory_ord", F.col("ord").cast("long").alias("ord"), "t.token_id", "t.value")


def sliced(tokens: DataFrame, cutoff_h: float = C.CUTOFF_H) -> DataFrame:
    """Tokens with ids by trajectory: trajectory_ord, anchor_us (of its first token), t_us and
    dt_us on its own clock, and on its first token the type and site of the window it is in."""
    rows = segments._followed(tokens, cutoff_h)
    window, own = W.partitionBy("subject_id", "window_ord"), W.partitionBy("subject_id", "trajectory_ord")
    first = lambda c: F.min_by(c, "idx").over(window)
    kind = segments._typed(first("opens"), first(F.struct("type_id"))["type_id"], F.col("window_ord"), segments._UNK)
    any_site = F.min_by("site", F.when(F.col("site").isNotNull(), F.col("idx"))).over(window)
    rows = rows.withColumns({"w_type": kind, "w_site": F.coalesce(first("opens")["w_site"], any_site)})
    rows = rows.withColumns({"head": F.col("idx") == F.min("idx").over(own), "begin": F.min_by("t_us", "idx").over(own), "anchor_us": F.min_by("raw_us", "idx").over(own)})
    rows = rows.withColumns({"type_id": F.when(F.col("head"), F.col("w_type")).otherwise(F.col("type_id")), "site": F.when(F.col("head"), F.col("w_site")).otherwise(F.col("site"))})
    return rows.withColumns({"t_us": F.greatest(F.col("t_us") - F.col("begin"), F.lit(0)), "dt_us": F.when(F.col("head"), F.lit(0)).otherwise(F.col("dt_us"))}).drop("w_type", "w_site", "begin")


def materialised(tokens: DataFrame, events: DataFrame, cutoff_h: float = C.CUTOFF_H) -> DataFrame:
    """One row a token of each trajectory's own timeline: subject_id, trajectory_ord, place
    (from 0, specials first), kind, category, gid, value, t_us, dt_us, type_id, site, hook."""
    rows = sliced(tokens, cutoff_h)
    anchors = rows.where("head").select("subject_id", "trajectory_ord", "anchor_us")
    none = lambda t: F.lit(None).cast(t)
    front = specials(events, anchors).select("subject_id", "trajectory_ord", F.lit(0).alias("part"), F.col("ord").alias("at"), F.lit("SPECIAL").alias("kind"), F.lit("SPECIAL").alias("category"), F.col("token_id").cast("long").alias("gid"), "value", F.lit(0).cast("long").alias("t_us"), F.lit(0).cast("long").alias("dt_us"), none("int").alias("type_id"), none("string").alias("site"), F.lit(False).alias("hook"))
    body = rows.select("subject_id", "trajectory_ord", F.lit(1).alias("part"), F.col("idx").alias("at"), "kind", "category", "gid", "value", "t_us", "dt_us", "type_id", "site", "hook")
    place = F.row_number().over(W.partitionBy("subject_id", "trajectory_ord").orderBy("part", "at")).cast("long") - 1
    return front.unionByName(body).withColumn("place", place).drop("part", "at")
