"""Vocabularies: looking codes up in a cascade of stages, and choosing what to keep.

Codes are few and events many: every operator works on distinct codes with their counts
and is joined back to events where needed. Vocabulary tables may be broadcast by Spark's
own size check; nothing here forces it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config as C
from ..functions import routing as R
from ..functions import text as T

FAMILIES = ("DIAGNOSIS", "PROCEDURE", "MEDICATION")
STAGES = ("exact", "canonicalized", "parent_lookup", "crosswalk_lookup", "lexical_bridge", "residual_exact", "residual_hash")


def code_counts(events: DataFrame) -> DataFrame:
    """category, code, base (without its interval marker) and n of the coded families; a
    table of them is passed through."""
    if "base" in events.columns:
        return events
    return with_bases(events.groupBy("category", "code").agg(F.count("*").alias("n")))


def with_bases(counts: DataFrame) -> DataFrame:
    """The rows of counts(category, code, n) of the coded families, with base."""
    return counts.where(F.col("category").isin(*FAMILIES)).select("category", "code", "n", R.unmarked(F.col("code")).alias("base"))


def numbered(codes: DataFrame, *by: str) -> DataFrame:
    """codes(category, entry) with raw_id from 1 in the order of the entry; 0 is unknown."""
    return codes.withColumn("raw_id", F.row_number().over(W.partitionBy("category").orderBy(*(by or ("entry",)))).cast("long"))


def resolve(events: DataFrame, vocab: DataFrame, parents: DataFrame | None = None, crosswalk: DataFrame | None = None, residual: DataFrame | None = None, drop_unknowns: bool = False, hashed: bool = True) -> DataFrame:
    """category, code, n, stage, hit and gid of each distinct code of events (or of their
    code_counts, which spares a second look at them).

    Candidate spellings are listed with their stage and place; the first that the
    vocabulary(category, entry, raw_id) holds decides. parents(category, key, parent)
    and crosswalk(category, key, target) add spellings; a name that is the lexical key
    of one entry only stands for it; residual(category, entry, raw_id) comes after; the
    rest fall into hash buckets behind it, or, if not hashed, get the family's unknown id
    (stage unk). With drop_unknowns what no table holds is left out.
    """
    codes = code_counts(events)
    known = vocab.select("category", F.lit("entry").alias("kind"), "entry", (F.col("raw_id") + _offset("")).alias("gid"))
    if residual is not None:
        known = known.unionByName(residual.select("category", F.lit("residual").alias("kind"), "entry", (F.col("raw_id") + _offset("_residual")).alias("gid")))
    probe = lambda stage, kind, names: F.transform(names, lambda x, i: F.struct(F.lit(stage).alias("stage_no"), i.alias("place"), F.lit(kind).alias("kind"), x.alias("name")))

    def probes(r):
        code, base, category = r["code"], r["base"], r["category"]
        above = F.array_distinct(F.array(F.upper(code), F.upper(base), F.upper(T.without_action(code))))
        # every code keeps a row, so that those that meet nothing need no second look at the codes
        none = F.array(F.struct(F.lit(9).alias("stage_no"), F.lit(0).alias("place"), F.lit("none").alias("kind"), code.alias("name")))
        some = F.concat(none, probe(0, "entry", F.array(base, code)), probe(1, "entry", T.candidates(base, category)), probe(2, "parent", above), probe(3, "name", T.lexical_keys(code, category)), probe(5, "residual", T.residual_candidates(code, base, category)))
        return F.filter(some, lambda x: x["name"].isNotNull())

    # bound: the rules are far too long for one compiled method, and codes are few
    found = T.bound(F.struct("code", "base", "category"), probes)
    every = codes.select("category", "code", "base", "n", F.explode(found).alias("p")).select("category", "code", "base", "n", "p.*")
    bridge = vocab.withColumn("name", T.lexical_key(F.element_at(F.split("entry", "//"), -1))).where("name is not null").groupBy("category", "name").agg(F.min("entry").alias("entry"), F.count_distinct("entry").alias("k")).where("k = 1")
    links = bridge.select("category", F.lit("name").alias("kind"), "name", F.lit(4).alias("to"), F.array("entry").alias("entries"))
    if crosswalk is not None:
        links = links.unionByName(crosswalk.select("category", F.lit("name").alias("kind"), F.col("key").alias("name"), F.lit(3).alias("to"), F.array("target").alias("entries")))
    if parents is not None:
        spelled = T.bound(F.struct("parent", "category"), lambda r: F.array_distinct(F.concat(F.array(r["parent"]), F.coalesce(T.candidates(r["parent"], r["category"]), F.array().cast("array<string>")))))
        links = links.unionByName(parents.select("category", F.lit("parent").alias("kind"), F.col("key").alias("name"), F.lit(2).alias("to"), spelled.alias("entries")))
    linked = every.join(links, ["category", "kind", "name"], "left")
    direct = F.col("kind").isin("entry", "residual")
    tried = linked.select("category", "code", "base", "n", F.coalesce("to", "stage_no").alias("stage_no"), "place", F.when(F.col("kind") == "residual", "residual").otherwise("entry").alias("kind"), F.posexplode_outer(F.when(direct, F.array("name")).otherwise(F.col("entries"))).alias("at", "entry"))
    met = tried.join(known, ["category", "kind", "entry"], "left")
    best = F.min_by(F.struct("stage_no", "entry", "gid"), F.when(F.col("gid").isNotNull(), F.struct("stage_no", "place", "at", "entry")))
    out = met.groupBy("category", "code", "base", "n").agg(best.alias("b"))
    if drop_unknowns:
        out = out.where("b is not null")
    names = F.array(*map(F.lit, STAGES))
    key = F.get(T.residual_candidates(F.col("code"), F.col("base"), F.col("category")), F.lit(0))
    tail = F.crc32(F.encode(key, "UTF-8")) % C.RESIDUAL_BUCKETS + 1 + _offset("_residual")
    if not hashed:
        return out.select("category", "code", "n", F.coalesce(F.get(names, F.col("b.stage_no")), F.lit("unk")).alias("stage"), "b.entry", F.coalesce("b.gid", _offset("")).alias("gid")).withColumnRenamed("entry", "hit")
    return out.select("category", "code", "n", F.coalesce(F.get(names, F.col("b.stage_no")), F.lit(STAGES[-1])).alias("stage"), F.coalesce("b.entry", key).alias("hit"), F.coalesce(F.col("b.gid"), tail).alias("gid"))


def _offset(suffix: str):
    return F.when(F.col("category") == "DIAGNOSIS", C.FAMILY_OFFSETS["diagnosis" + suffix]).when(F.col("category") == "PROCEDURE", C.FAMILY_OFFSETS["procedure" + suffix]).otherwise(C.FAMILY_OFFSETS["medication" + suffix])


def extended(vocab: DataFrame, aliases: DataFrame) -> DataFrame:
    """vocab(category, entry, raw_id) with an id for the first target of each of
    aliases(category, ord, targets) that is not there yet: ids go on from the family's largest
    (from 0 if it has none), in the order in which targets first stand. Aliases without
    targets add nothing. New entries are numbered by family; a target costs one row."""
    first = aliases.select("category", F.get("targets", F.lit(0)).alias("entry"), "ord").where("entry is not null").groupBy("category", "entry").agg(F.min("ord").alias("ord"))
    new = first.join(vocab.select("category", "entry"), ["category", "entry"], "left_anti")
    top = vocab.groupBy("category").agg(F.max("raw_id").alias("top"))
    nth = F.row_number().over(W.partitionBy("category").orderBy("ord", "entry"))
    added = new.withColumn("nth", nth).join(top, "category", "left").select("category", "entry", (F.coalesce("top", F.lit(-1)) + F.col("nth")).cast("long").alias("raw_id"))
    return vocab.select("category", "entry", F.col("raw_id").cast("long").alias("raw_id")).unionByName(added)


def full_target(events: DataFrame, vocab: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """category, code and target: a code's first spelling in the vocabulary that is not its
    unknown entry (of medications none that says too little), else the crosswalk's target,
    whether or not the vocabulary has it."""
    codes = code_counts(events).select("category", "code")
    tried = codes.select("category", "code", F.posexplode(T.candidates(F.col("code"), F.col("category"))).alias("place", "entry"))
    tried = tried.where((F.col("category") != "MEDICATION") | ~T.low_specificity(F.col("entry")))
    hit = tried.join(vocab.where("raw_id <> 0"), ["category", "entry"]).groupBy("category", "code").agg(F.min_by("entry", "place").alias("hit"))
    keys = codes.select("category", "code", F.posexplode(T.lexical_keys(F.col("code"), F.col("category"))).alias("place", "key"))
    other = keys.join(crosswalk, ["category", "key"]).groupBy("category", "code").agg(F.min_by("target", "place").alias("other"))
    both = codes.join(hit, ["category", "code"], "left").join(other, ["category", "code"], "left")
    return both.select("category", "code", F.coalesce("hit", "other").alias("target"))


def matched(events: DataFrame, vocab: DataFrame) -> DataFrame:
    """category, code, n and whether any canonical spelling is in the vocabulary: weaker
    than ``resolve``, as the code itself, its parents and the crosswalk don't count."""
    codes = code_counts(events)
    tried = codes.select("category", "code", F.explode(T.candidates(F.col("code"), F.col("category"))).alias("entry"))
    hit = tried.join(vocab.select("category", "entry"), ["category", "entry"], "left_semi").select("category", "code").distinct().withColumn("hit", F.lit(True))
    return codes.join(hit, ["category", "code"], "left").select("category", "code", "n", F.coalesce("hit", F.lit(False)).alias("hit"))


def residual_vocab(events: DataFrame, vocab: DataFrame, crosswalk: DataFrame, share: float, most: int) -> DataFrame:
    """category, entry, n and raw_id: the keys of codes that resolve to nothing and mark no
    interval, commonest first, up to the one that reaches the share, most at most."""
    codes = code_counts(events)
    left = codes.join(full_target(events, vocab, crosswalk).where("target is null"), ["category", "code"], "left_semi").where(R.marker(F.col("code")).isNull())
    keys = left.groupBy("category", F.get(T.residual_candidates(F.col("code"), F.col("code"), F.col("category")), F.lit(0)).alias("entry")).agg(F.sum("n").alias("n"))
    w = W.partitionBy("category").orderBy(F.desc("n"), "entry")
    keys = keys.withColumns({"raw_id": F.row_number().over(w).cast("long"), "before": F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("n").over(W.partitionBy("category"))})
    return keys.where((F.col("raw_id") <= most) & ((F.col("raw_id") == 1) | (F.col("before") / F.col("total") < share))).select("category", "entry", "n", "raw_id")


def lexical_bridge(names: DataFrame) -> DataFrame:
    """key and name of lexical keys that stand for one name only."""
    k = names.withColumn("key", T.lexical_key(F.col("name"))).where("key is not null")
    return k.groupBy("key").agg(F.count_distinct("name").alias("k"), F.min("name").alias("name")).where("k = 1").drop("k")


def crosswalk(concepts: DataFrame) -> DataFrame:
    """category, key, target of concepts(category, label, target, ord): aliases of a
    label, kept where they lead to one target only."""
    k = concepts.select("category", "target", "ord", F.explode(T.aliases(F.col("label"))).alias("a")).withColumn("key", T.lexical_key(F.col("a"))).where("key is not null")
    return k.groupBy("category", "key").agg(F.count_distinct("target").alias("k"), F.min_by("target", "ord").alias("target")).where("k = 1").drop("k")


def coverage_vocab(counts: DataFrame, target: float, most: int) -> DataFrame:
    """The commonest codes up to the one that reaches the target share, most at most."""
    w = W.orderBy(F.desc("n"), "code")
    k = counts.withColumn("raw_id", F.row_number().over(w).cast("long")).withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("n").over(W.partitionBy(F.lit(1))))
    return k.where((F.col("raw_id") <= most) & ((F.col("raw_id") == 1) | (F.col("before") / F.col("total") < target))).select("code", "n", "raw_id")


def family_vocab(counts: DataFrame, target: float) -> DataFrame:
    """Rare critical codes, then the commonest while the share before them is below the
    target. counts: code, rare, n."""
    w = W.orderBy(F.desc("rare"), F.desc("n"), "code")
    k = counts.withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("n").over(W.partitionBy(F.lit(1))))
    return k.where(F.col("rare") | (F.col("before") / F.col("total") < target)).drop("before", "total")


def surface_floor(counts: DataFrame, floor: int) -> DataFrame:
    """Rare critical codes, and of each surface its commonest others up to the floor."""
    nth = F.row_number().over(W.partitionBy("surface", "rare").orderBy(F.desc("n"), "code"))
    return counts.withColumn("nth", nth).where(F.col("rare") | (F.col("nth") <= floor)).drop("nth")


def budget(counts: DataFrame, size: int, floor: int) -> DataFrame:
    """surface, code, n, picked_by: size codes in four passes: rare critical ones; the
    floor of each surface; quotas by the square root of its events with the largest
    remainders first; what is left by count alone."""
    nth = F.row_number().over(W.partitionBy("surface", "rare").orderBy(F.desc("n"), "code"))
    k = counts.withColumn("nth", nth)
    first = F.when(F.col("rare"), 0).when(F.col("nth") <= floor, 1)
    k = k.withColumn("pass", first)
    used = k.agg(F.count("pass").alias("used"))
    weight = k.groupBy("surface").agg(F.sqrt(F.sum("n")).alias("w")).join(F.broadcast(used))
    total = W.partitionBy(F.lit(1))
    share = F.greatest(F.lit(size) - F.col("used"), F.lit(0)) * F.col("w") / F.sum("w").over(total)
    quota = weight.withColumn("share", share).withColumn("q", F.floor("share"))
    over = F.greatest(F.lit(size) - F.col("used"), F.lit(0)) - F.sum("q").over(total)
    rank = F.row_number().over(W.orderBy(F.desc(F.col("share") - F.col("q")), F.desc("surface")))
    quota = quota.withColumn("over", over).withColumn("rank", rank).select("surface", (F.col("q") + F.when(F.col("rank") <= F.col("over"), 1).otherwise(0)).alias("quota"))
    k = k.join(quota, "surface")
    free = F.row_number().over(W.partitionBy("surface", F.col("pass").isNull()).orderBy(F.desc("n"), "code"))
    k = k.withColumn("pass", F.coalesce("pass", F.when(free <= F.col("quota"), 2), F.lit(3)))
    order = F.row_number().over(W.orderBy("pass", F.desc("n"), "code"))
    names = F.array(*map(F.lit, ("rare", "floor", "quota", "fill")))
    return k.withColumn("order", order).where(F.col("order") <= size).select("surface", "code", "n", F.get(names, F.col("pass")).alias("picked_by"))


# --- small tables for the shared test data ---


#: Base codes that stay out of the vocabulary, so that each later stage has its code, and
#: entries that stand for them.
LEFT_OUT = ("ICD10CM//A12.3", "DIAGNOSIS//ICD//9//V5867", "MEDICATION//Acetaminophen//Administered", "MEDICATION//Hydromorphone (Dilaudid)//Administered", "PROCEDURE//CT scan")
ADDED = (("DIAGNOSIS", "ICD10CM//A123"), ("DIAGNOSIS", "TEXT//diagnosis icd 9 v5867"), ("MEDICATION", "RXNORM//161"), ("PROCEDURE", "PROCEDURE//CPT//99213"))


def sample_vocab(events: DataFrame) -> DataFrame:
    """Two in three of the base codes, in order, without LEFT_OUT and the started drugs,
    and ADDED: every stage has something to do, at every size."""
    bases = code_counts(events).select("category", F.col("base").alias("entry")).distinct()
    bases = bases.where(~F.col("entry").isin(*LEFT_OUT) & ~F.col("entry").startswith("MEDICATION//DRUG"))
    some = bases.withColumn("r", F.row_number().over(W.partitionBy("category").orderBy("entry"))).where("r % 3 <> 0").drop("r")
    added = events.sparkSession.createDataFrame(ADDED, "category string, entry string")
    return numbered(some.union(added).distinct())


def sample_parents(events: DataFrame) -> DataFrame:
    drugs = code_counts(events).where(F.col("code").startswith("MEDICATION//START//")).select("category", F.upper("code").alias("key"), F.lit("RXNORM//161").alias("parent"))
    return drugs.distinct()


def sample_crosswalk(spark: SparkSession) -> DataFrame:
    rows = [("MEDICATION", "Hydromorphone (Dilaudid)", "RXNORM//161", 0), ("PROCEDURE", "CT scan", "PROCEDURE//CPT//99213", 1)]
    return crosswalk(spark.createDataFrame(rows, "category string, label string, target string, ord int"))


def sample_residual(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("MEDICATION", "MEDICATION//ACETAMINOPHEN", 1)], "category string, entry string, raw_id int")
