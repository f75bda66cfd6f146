"""Token ids back to readable items.

A measurement's code id takes the value ids behind it, an observation's code id the value id
behind it; everything else is an item of its own. The sequential rule is a few window functions
over the subject, so decoding adds no shuffle to the timeline's partitioning but for the names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config as C

#: Names of special ids: demographic tokens, window types, END and CONTINUE.
SPECIAL_NAMES = {
    30: "SEX_F", 31: "SEX_M", 32: "AGE_U18", 33: "AGE_18_39", 34: "AGE_40_64", 35: "AGE_65_79", 36: "AGE_80P", 37: "BMI_UNDER", 38: "BMI_NORMAL", 39: "BMI_OVER", 40: "BMI_OBESE_1", 41: "BMI_OBESE_2",
    42: "BMI_OBESE_3", 43: "HEIGHT_AT_ADMISSION", 44: "WEIGHT_AT_ADMISSION",
}


def names(vocab: DataFrame, structural: DataFrame, measurements: DataFrame, residual: DataFrame | None = None) -> DataFrame:
    """gid and name of the ids of vocab(category, entry, raw_id), structural(entry, raw_id),
    measurements(code, var_id) and residual(category, entry, raw_id)."""
    at = C.FAMILY_OFFSETS
    offset = lambda suffix: F.when(F.col("category") == "DIAGNOSIS", at["diagnosis" + suffix]).when(F.col("category") == "PROCEDURE", at["procedure" + suffix]).otherwise(at["medication" + suffix])
    rows = vocab.select((F.col("raw_id") + offset("")).alias("gid"), F.col("entry").alias("name"))
    rows = rows.union(structural.select(F.col("raw_id") + at["structural"], "entry")).union(measurements.select(F.col("var_id") + at["measurement_code"], "code"))
    return rows if residual is None else rows.union(residual.select(F.col("raw_id") + offset("_residual"), "entry"))


def measurement_class(category: Column, gid: Column, level: Column, pair: Column) -> tuple[Column, Column]:
    """Whether a token is a measurement's code, and whether it counts as one of its value ids.

    pair is 1 or 2 for the two ids of an observation, else 0. Without a level every id from
    the value ids on counts as one."""
    at = C.FAMILY_OFFSETS
    measured = category == "MEASUREMENT"
    code = measured & (pair == 0) & level.isNull() & (gid >= at["measurement_code"]) & (gid < at["measurement_value"])
    return code, measured & (level.isNotNull() | (gid >= at["measurement_value"]))


def spans(tokens: DataFrame, levels: int | None) -> DataFrame:
    """tokens(subject_id, idx, kind, category, gid, level, ...) with item (from 0 in each
    history), opens (whether the token begins its item) and item_kind.

    A measurement's code takes up to ``levels`` value ids (None: all) that follow it at once."""
    w = W.partitionBy("subject_id").orderBy("idx")
    so_far, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    pair = F.when(F.col("kind") == "OBS_CODE", 1).when(F.col("kind") == "OBS_VALUE", 2).otherwise(0)
    code, value = measurement_class(F.col("category"), F.col("gid"), F.col("level"), pair)
    rows = tokens.withColumns({"_pair": pair, "_code": F.coalesce(code, F.lit(False)), "_value": F.coalesce(value, F.lit(False)), "_nth": F.row_number().over(w)})
    last = F.last(F.when(~F.col("_value"), F.struct("_nth", "_code")), ignorenulls=True).over(before)
    rows = rows.withColumn("_last", last)
    reach = F.lit(True) if levels is None else F.col("_nth") - F.col("_last._nth") <= levels
    rows = rows.withColumn("_taken", F.coalesce(F.col("_value") & F.col("_last._code") & reach, F.lit(False)))
    first = F.coalesce((F.col("_pair") == 1) & ~F.col("_taken"), F.lit(False))
    second = F.coalesce((F.col("_pair") == 2) & F.lag(first).over(w), F.lit(False))
    rows = rows.withColumns({"_second": second, "_first": first})
    joined = F.col("_first") & F.coalesce(F.lead("_second").over(w), F.lit(False))
    kind = F.when(F.col("_code"), "measurement_bundle").when(joined, "observation_bundle").otherwise("token")
    opens = ~(F.col("_taken") | F.col("_second"))
    rows = rows.withColumns({"opens": opens, "item_kind": F.when(opens, kind)})
    rows = rows.withColumn("item", F.sum(F.when(F.col("opens"), 1).otherwise(0)).over(so_far) - 1)
    return rows.drop("_pair", "_code", "_value", "_nth", "_last", "_taken", "_first", "_second")


def label(category: Column, gid: Column, kind: Column, name: Column, structural_label: Column, mark: Column) -> Column:
    """What a single token is called; null where no vocabulary names it."""
    at = C.FAMILY_OFFSETS
    special = F.create_map(*[F.lit(x) for i, n in SPECIAL_NAMES.items() for x in (i, n)])
    own = F.coalesce(F.try_element_at(special, gid.cast("int")), F.concat(F.lit("SPECIAL::"), gid))
    observed = F.when(gid >= at["observation_value"], F.concat(F.lit("OBS_VAL::"), gid - at["observation_value"])).when(gid >= at["observation_code"], F.concat(F.lit("OBS_CODE::"), gid - at["observation_code"]))
    process = F.when(gid >= C.PROCESS_ENTITY_OFFSET, F.concat(F.lit("STRUCT_ENT::"), gid - C.PROCESS_ENTITY_OFFSET)).when(gid >= C.PROCESS_ACTION_OFFSET, F.concat(F.lit("STRUCT_ACT::"), gid - C.PROCESS_ACTION_OFFSET))
    marked = F.when((category == "MEDICATION") & (kind == "MARK"), F.concat(F.lit("MED_MARKER::"), mark))
    return (
        F.when(category == "SPECIAL", own).when(category == "MEASUREMENT", observed).when(category == "STRUCTURAL", F.coalesce(process, structural_label, name))
        .when(category.isin("DIAGNOSIS", "PROCEDURE", "MEDICATION"), F.coalesce(marked, name))
    )


def items(tokens: DataFrame, known: DataFrame, levels: int | None, stride: int) -> DataFrame:
    """One row an item of a timeline with ids: subject_id, item, item_kind, category, gid,
    label, value_gid (of an observation), codes (of a measurement's value ids), value, t_us,
    dt_us, hook, action and type_id (of structural items) and its span of tokens, lo to hi.

    known(gid, name) are the names of ids; a structural token's own label goes first. lo and hi
    are places in the history, so they add up without gaps."""
    at = C.FAMILY_OFFSETS
    rows = spans(tokens, levels)
    first = F.col("opens")
    place = F.row_number().over(W.partitionBy("subject_id").orderBy("idx")).cast("long") - 1
    rows = rows.withColumn("place", place)
    one = lambda c: F.max(F.when(first, F.col(c)))
    taken = F.collect_list(F.when(~first, F.struct("place", (F.pmod(F.col("gid") - at["measurement_value"], F.lit(stride))).alias("code"), "gid")))
    out = rows.groupBy("subject_id", "item").agg(
        one("item_kind").alias("item_kind"), one("category").alias("category"), one("kind").alias("kind"), one("gid").alias("gid"), one("surface").alias("surface"), one("label").alias("own_label"), one("value").alias("value"),
        one("t_us").alias("t_us"), one("dt_us").alias("dt_us"), one("hook").alias("hook"), one("action").alias("action"), one("type_id").alias("type_id"), F.min("place").alias("lo"), F.max("place").alias("hi"), F.sort_array(taken).alias("x"),
    )
    # broadcast, as a vocabulary is: a join by gid would deal all items by few ids
    out = out.join(F.broadcast(known.select("gid", "name")), "gid", "left")
    is_pair, is_bundle = F.col("item_kind") == "observation_bundle", F.col("item_kind") == "measurement_bundle"
    called = F.when(is_bundle, F.col("name")).when(~is_pair, label(F.col("category"), F.col("gid"), F.col("kind"), F.col("name"), F.col("own_label"), F.col("surface")))
    return out.select(
        "subject_id", "item", "item_kind", "category", "gid", called.alias("label"), F.when(is_pair, F.get("x.gid", F.lit(0))).alias("value_gid"), F.when(is_bundle, F.col("x.code")).alias("codes"), "value", "t_us", "dt_us", "hook",
        *[F.when(F.col("category") == "STRUCTURAL", F.col(c)).alias(c) for c in ("action", "type_id")], "lo", "hi",
    )


def sparse(dense: DataFrame, blocks: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """dense(dense_id, ...) with block, gid and exact: the id that a model's id stands for, by
    the table (gid, name, dense_id) of compact blocks, else by the block's place. An id of a
    block that wraps around gets the first that it stands for, and is not exact; ids beyond the
    blocks get null. Blocks are a short list, a row a family."""
    b = blocks.select("name", "global_offset", "source_size", "dense_size", "dense_offset", "mode")
    hit = dense.join(F.broadcast(b), (F.col("dense_id") >= F.col("dense_offset")) & (F.col("dense_id") < F.col("dense_offset") + F.col("dense_size")), "left")
    found = F.col("global_offset") + (F.col("dense_id") - F.col("dense_offset"))
    if table is not None:
        hit = hit.join(table.select("dense_id", F.col("gid").alias("listed")), "dense_id", "left")
        found = F.when(F.col("mode") == "lookup", F.col("listed")).otherwise(found)
    exact = F.coalesce((F.col("mode") != "modulo") & found.isNotNull(), F.lit(False))
    return hit.select(*dense.columns, F.col("name").alias("block"), found.alias("gid"), exact.alias("exact"))

