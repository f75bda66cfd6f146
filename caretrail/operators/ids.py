"""Global ids of tokens, and their remapping to the dense ids of a model.

Blocks are a short list (a row a family), so joins with them are broadcast ones by their
fixed size; the observed ids of a compact layout are a table and joined as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config as C
from ..functions import numeric as N
from ..functions import routing as R
from ..functions import text as T

MODES = ("identity", "modulo", "lookup")


def observation_ids(events: DataFrame, codes: DataFrame | None = None, values: DataFrame | None = None, tail: str = "hash") -> DataFrame:
    """subject_id, pos, code_gid, value_gid, code_exact, value_exact of observations.

    codes and values (surface, raw_id) are vocabularies; what they lack is left out (tail
    "drop") or goes to a hash lane, a few values to reserved ids first."""
    e = events.select("subject_id", "pos", T.observation_surface(F.col("code")).alias("code_surface"), T.code_value(F.col("code")).alias("value_surface")).where("code_surface is not null")
    lane = C.FAMILY_OFFSETS["observation_value"] - C.FAMILY_OFFSETS["observation_code"] - 1
    none = e.sparkSession.createDataFrame([], "surface string, raw_id long")
    for name, table in (("code", codes), ("value", values)):
        known = none if table is None else table
        e = e.join(known.select(F.col("surface").alias(f"{name}_surface"), F.col("raw_id").alias(f"{name}_raw")), f"{name}_surface", "left")
        if table is not None and tail == "drop":
            e = e.where(f"{name}_raw is not null")
    reserved = R.lookup({k: str(v) for k, v in C.OBSERVATION_VALUES.items()}, F.upper("value_surface")).cast("long")
    code = F.coalesce("code_raw", N.hash_lane(F.col("code_surface"), lane))
    value = F.coalesce("value_raw", reserved, N.hash_lane(F.concat(F.lit("OBS_VAL::"), F.col("value_surface")), C.OBSERVATION_VALUE_LANE))
    return e.select("subject_id", "pos", (code + C.FAMILY_OFFSETS["observation_code"]).alias("code_gid"), (value + C.FAMILY_OFFSETS["observation_value"]).alias("value_gid"), F.col("code_raw").isNotNull().alias("code_exact"), F.col("value_raw").isNotNull().alias("value_exact"))


def process_ids(events: DataFrame) -> DataFrame:
    """subject_id, pos, action, domain, action_gid and entity_gid of events that begin or
    end a medication, procedure or infusion."""
    c, p = F.col("code"), T.parts(F.col("code"))
    head, mark = F.upper(F.get(p, F.lit(0))), F.upper(F.get(p, F.lit(1)))
    infusion = F.upper(F.trim(c)).rlike("^INFUSION_(START|END)//")
    marked = (F.size(p) >= 3) & head.isin("MEDICATION", "PROCEDURE") & mark.isin(*C.PROCESS_ACTIONS)
    action = F.when(infusion, F.regexp_extract(head, "_(.*)$", 1)).when(marked, mark)
    domain = F.when(infusion, "INFUSION").when(marked, head)
    entity = F.when(infusion, F.regexp_replace(F.trim(c), "^.*?//", "")).when(marked, F.trim(F.array_join(F.slice(p, 3, 999), "//")))
    local = F.when(entity.rlike("^[0-9]+$"), F.try_to_number(entity, F.lit("9" * 18)).cast("long")).otherwise(N.hash_lane(F.concat_ws("::", domain, entity), C.ENTITY_LANE))
    number = lambda table, key: R.lookup({k: str(v) for k, v in table.items()}, key).cast("long")
    rows = events.select("subject_id", "pos", action.alias("action"), domain.alias("domain"), entity.alias("entity"), local.alias("local")).where("action is not null and entity <> ''")
    return rows.select("subject_id", "pos", "action", "domain", (number(C.PROCESS_ACTIONS, F.col("action")) + C.PROCESS_ACTION_OFFSET).alias("action_gid"), (F.col("local") + C.PROCESS_ENTITY_OFFSET).alias("entity_gid"))


def family(gid: Column) -> Column:
    """The audit's family of a global id: attributes count as medication, and what is in
    no range as special."""
    at = C.FAMILY_OFFSETS
    return (
        F.when(gid >= at["observation_value"], "observation_value").when(gid >= at["observation_code"], "observation_code").when(gid >= at["structural"], "structural")
        .when(gid >= at["measurement_value"], "measurement_value").when(gid >= at["measurement_code"], "measurement_code").when(gid >= at["medication"], "medication_or_med_attr")
        .when(gid >= at["procedure"], "procedure").when(gid >= at["diagnosis"], "diagnosis").otherwise("special_or_window")
    )


def layout(spark: SparkSession, sizes: dict[str, int], dense: dict[str, int] | None = None) -> DataFrame:
    """name, lane, global_offset, source_size, dense_size, mode, ord and dense_offset of the
    blocks that have a lane, laid out lane by lane. A block with fewer dense ids than it
    has (dense) wraps around (modulo)."""
    rows = [(n, C.BLOCK_LANES[n], C.LANES.index(C.BLOCK_LANES[n]), i, C.FAMILY_OFFSETS[n], sizes[n], (dense or {}).get(n, sizes[n])) for i, n in enumerate(C.BLOCK_LANES) if n in sizes]
    b = spark.createDataFrame(rows, "name string, lane string, lane_ord int, ord int, global_offset long, source_size long, dense_size long")
    before = F.sum("dense_size").over(W.orderBy("lane_ord", "ord").rowsBetween(W.unboundedPreceding, -1))
    mode = F.when(F.col("dense_size") < F.col("source_size"), "modulo").otherwise("identity")
    return b.withColumn("mode", mode).withColumn("dense_offset", F.coalesce(before, F.lit(0)))


def compacted(blocks: DataFrame, observed: DataFrame, preserve: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Blocks that keep the observed(gid) ids alone, and their table (gid, name, dense_id).

    A block of which none was seen keeps its first id; those of ``preserve`` stay whole and
    have no rows in the table."""
    ends = F.col("global_offset") + F.col("source_size") - 1
    seen = observed.select("gid").distinct().join(F.broadcast(blocks), (F.col("gid") >= F.col("global_offset")) & (F.col("gid") <= ends)).where(~F.col("name").isin(*preserve)).select("name", "gid")
    free = blocks.where(~F.col("name").isin(*preserve)).join(seen.select("name").distinct(), "name", "left_anti").select("name", F.col("global_offset").alias("gid"))
    kept = seen.union(free)
    size = kept.groupBy("name").agg(F.count("*").alias("n"), F.min("gid").alias("low"), F.max("gid").alias("high"))
    b = blocks.drop("dense_offset").join(F.broadcast(size), "name", "left")
    whole = F.col("n").isNull()
    b = b.select("name", "lane", "lane_ord", "ord", F.coalesce("low", "global_offset").alias("global_offset"), F.when(whole, F.col("source_size")).otherwise(F.col("high") - F.col("low") + 1).alias("source_size"), F.coalesce("n", "dense_size").alias("dense_size"), F.when(whole, F.col("mode")).otherwise("lookup").alias("mode"))
    before = F.sum("dense_size").over(W.orderBy("lane_ord", "ord").rowsBetween(W.unboundedPreceding, -1))
    b = b.withColumn("dense_offset", F.coalesce(before, F.lit(0)))
    rank = F.row_number().over(W.partitionBy("name").orderBy("gid")) - 1
    table = kept.withColumn("rank", rank).join(F.broadcast(b.select("name", "dense_offset")), "name").select("gid", "name", (F.col("dense_offset") + F.col("rank")).alias("dense_id"))
    return b, table


def lookup_problems(blocks: DataFrame, table: DataFrame) -> DataFrame:
    """name, problem and n of what a table(gid, name, dense_id) of lookup blocks has wrong:
    gid or dense_id repeated, gid outside its block, dense_id outside it, or no block."""
    b = blocks.select("name", "global_offset", "source_size", "dense_size", "dense_offset", "mode")
    rows = table.join(F.broadcast(b), "name", "left")
    outside = lambda x, lo, n: (F.col(x) < F.col(lo)) | (F.col(x) >= F.col(lo) + F.col(n))
    placed = F.when(F.col("mode").isNull() | (F.col("mode") != "lookup"), "no lookup block").when(outside("gid", "global_offset", "source_size"), "gid outside").when(outside("dense_id", "dense_offset", "dense_size"), "dense_id outside")
    found = rows.select("name", placed.alias("problem")).where("problem is not null").groupBy("name", "problem").agg(F.count("*").alias("n"))
    for c in ("gid", "dense_id"):
        twice = table.groupBy("name", c).agg(F.count("*").alias("k")).where("k > 1").groupBy("name").agg(F.count("*").alias("n"))
        found = found.unionByName(twice.select("name", F.lit(f"{c} repeated").alias("problem"), "n"))
    return found


def problems(blocks: DataFrame) -> DataFrame:
    """name and problem of blocks with a bad size or mode, or that overlap the one before."""
    w = W.orderBy("global_offset")
    ends = F.col("global_offset") + F.col("source_size") - 1
    checked = blocks.withColumn("before", F.lag(ends).over(w))
    found = F.when(F.col("source_size") <= 0, "source_size").when(F.col("dense_size") <= 0, "dense_size").when(~F.col("mode").isin(*MODES), "mode").when(F.col("global_offset") <= F.col("before"), "overlap")
    return checked.select("name", found.alias("problem")).where("problem is not null")


def remapped(ids: DataFrame, blocks: DataFrame, table: DataFrame | None = None, unknown: int = 0) -> DataFrame:
    """ids(gid, ...) with block and dense_id: by the table for lookup blocks, else by the
    block's range, wrapped where it has fewer dense ids; unknown where no block holds it."""
    b = blocks.select("name", "global_offset", "source_size", "dense_size", "dense_offset", "mode")
    hit = ids.join(F.broadcast(b), (F.col("gid") >= F.col("global_offset")) & (F.col("gid") < F.col("global_offset") + F.col("source_size")), "left")
    ranged = F.col("dense_offset") + (F.col("gid") - F.col("global_offset")) % F.col("dense_size")
    if table is not None:
        hit = hit.join(table.select("gid", F.col("dense_id").alias("found")), "gid", "left")
        ranged = F.when(F.col("mode") == "lookup", F.col("found")).otherwise(ranged)
    block = F.when(ranged.isNotNull(), F.col("name"))
    return hit.select(*ids.columns, block.alias("block"), F.coalesce(ranged, F.lit(unknown)).alias("dense_id"))


def remap_stats(mapped: DataFrame) -> DataFrame:
    """block (null: not mapped), n and its share of all."""
    n = mapped.groupBy("block").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))), 6))


def dense_metadata(blocks: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """dense_id, block, category_id, sparse_id and family of every dense id: unk for a
    block's own first id and for dense id 0, special_marker for the marker ids, null for
    other special ids."""
    rows = blocks.where("mode <> 'lookup'").select("name", "dense_offset", "global_offset", F.explode(F.sequence(F.lit(0).cast("long"), F.col("dense_size") - 1)).alias("i"))
    rows = rows.select((F.col("dense_offset") + F.col("i")).alias("dense_id"), F.col("name").alias("block"), (F.col("global_offset") + F.col("i")).alias("sparse_id"))
    if table is not None:
        rows = rows.unionByName(table.select("dense_id", F.col("name").alias("block"), F.col("gid").alias("sparse_id")))
    lookup = lambda t: R.lookup({k: str(v) for k, v in t.items()}, F.col("block")).cast("long")
    category = R.lookup({k: str(v) for k, v in C.BLOCK_CATEGORIES.items()}, F.regexp_extract("block", "^[a-z]+", 0)).cast("int")
    marker = F.col("dense_id").between(C.TYPE_TOKEN, C.TYPE_TOKEN + len(C.WINDOW_TYPES) - 1) | F.col("dense_id").isin(C.END_TOKEN, C.CONTINUE_TOKEN)
    name = F.when((F.col("block") == "special") & marker, "special_marker").when(F.col("dense_id") == 0, "unk").when(F.col("block") == "special", F.lit(None)).when(F.col("sparse_id") == lookup(C.FAMILY_OFFSETS), "unk").otherwise(F.col("block"))
    return rows.select("dense_id", "block", F.coalesce(category, F.lit(6)).alias("category_id"), "sparse_id", name.alias("family"))
