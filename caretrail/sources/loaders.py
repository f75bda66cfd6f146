"""Vocabularies, crosswalks, rules and reports from files.

Files are read by Spark where they may be large (Parquet, CSV, JSON maps), so a path can be
on any file system that Spark knows; rule files are short and read on the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C

DECISIONS = {"code": "string", "prefix": "string", "routed_category": "string", "events_total": "double", "captured_events": "double", "uncaptured_events": "double", "subject_coverage_frac": "double", "capture_rate": "double", "numeric_rate": "double", "uncaptured_reason_top": "string", "suggested_family": "string", "suggested_action": "string", "decision_status": "string"}


def exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def first_of(spark: SparkSession, *paths: str) -> str | None:
    """The first of some paths that is there."""
    return next((p for p in paths if exists(spark, p)), None)


def _map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """entry and value of a file that is one JSON object."""
    body = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{value}>").alias("m"))
    return body.select(F.explode("m").alias("entry", "value"))


def vocabulary(spark: SparkSession, path: str | None, category: str, optional: bool = False) -> DataFrame | None:
    """category, entry and raw_id of a JSON object code: id. Without a file: an error, or
    None if it is optional."""
    if path is None or not exists(spark, path):
        if optional:
            return None
        raise FileNotFoundError(f"no vocabulary at {path}")
    return _map(spark, path, "bigint").select(F.lit(category).alias("category"), "entry", F.col("value").alias("raw_id"))


def embeddings(spark: SparkSession, path: str) -> DataFrame:
    """code and vector of a JSON object code: [numbers]."""
    return _map(spark, path, "array<double>").select(F.col("entry").alias("code"), F.col("value").alias("vector"))


def parent_list(cell: Column) -> Column:
    """The codes of a cell that holds one code or a written list ("['a', 'b']"), trimmed,
    without blanks and repeats."""
    s = F.trim(cell)
    listed = F.from_json(F.regexp_replace(s, "'", '"'), "array<string>")
    both = F.when(s.startswith("[") & s.endswith("]"), F.coalesce(listed, F.array(s))).otherwise(F.array(s))
    return F.array_distinct(F.filter(F.transform(both, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def parents(codes: DataFrame, category: str) -> DataFrame:
    """category, key (upper case) and parent of codes(code, parent_codes), a row a parent;
    parent_codes is an array or a string that holds one or a list. Of rows with the same
    key the last one, in the order of the table, counts."""
    cell = F.col("parent_codes")
    if codes.schema["parent_codes"].dataType.simpleString() == "string":
        found = parent_list(cell)
    else:
        found = F.array_distinct(F.filter(F.transform(cell, lambda x: F.trim(x.cast("string"))), lambda x: x.isNotNull() & (x != "")))
    rows = codes.where("code is not null").select(F.upper("code").alias("key"), found.alias("found"), F.monotonically_increasing_id().alias("at"))
    last = rows.groupBy("key").agg(F.max_by("found", "at").alias("found"))
    return last.select(F.lit(category).alias("category"), "key", F.explode("found").alias("parent"))


def crosswalk_targets(spark: SparkSession, path: str, category: str) -> DataFrame:
    """category, key, place and target of a crosswalk file: families.<name>.aliases is an
    object alias: target or [targets]."""
    body = spark.read.text(path, wholetext=True).select(F.get_json_object("value", f"$.families.{category.lower()}.aliases").alias("a"))
    rows = body.select(F.explode(F.from_json("a", "map<string,string>")).alias("alias", "t"))
    key = F.upper(F.trim("alias"))
    targets = F.when(F.col("t").startswith("["), F.from_json("t", "array<string>")).otherwise(F.array("t"))
    clean = F.array_distinct(F.filter(F.transform(targets, lambda x: F.trim(x)), lambda x: x != ""))
    return rows.where(key != "").select(F.lit(category).alias("category"), key.alias("key"), F.posexplode(clean).alias("place", "target"))


def spellings(system: Column, code: Column) -> Column:
    """The spellings under which a vocabulary may hold a code of a system."""
    s, c = F.upper(F.trim(system)), F.trim(code)
    out = F.lit(None).cast("array<string>")
    for name, forms in C.SYSTEM_SPELLINGS.items():
        made = [F.replace(F.lit(f), F.lit("{}"), c) for f in forms]
        if name.startswith("ICD9"):
            made.append(F.replace(c, F.lit("."), F.lit("")))
        out = F.when(s == name, F.array_distinct(F.array(*made))).otherwise(out)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.coalesce(out, F.array().cast("array<string>")))


def concept_map(rows: DataFrame, category: str) -> DataFrame:
    """category, label, concept, targets and semantic_id of the rows of a concept map that
    have a label and a target. rows come from ``concept_file`` or a table."""
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    out = rows.select(F.lit(category).alias("category"), text("label").alias("label"), text("omop_concept_name").alias("concept"), spellings(text("omop_vocabulary_id"), text("omop_concept_code")).alias("targets"), F.concat_ws(":", text("omop_vocabulary_id"), text("omop_concept_code")).alias("semantic_id"))
    return out.where((F.col("label") != "") & (F.size("targets") > 0))


def concept_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, quote='"', escape='"')


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """A decision table from CSV, with all its columns: those that are absent, null or
    cannot be read get 0 or an empty string."""
    raw = spark.read.csv(path, header=True, escape='"')
    out = []
    for name, kind in DECISIONS.items():
        zero = F.lit(0.0) if kind == "double" else F.lit("")
        out.append(F.coalesce(F.col(name).try_cast(kind), zero).alias(name) if name in raw.columns else zero.alias(name))
    return raw.select(*out)


def rules(path: str) -> dict:
    """A codebook of structural rules (JSON, or YAML where a reader for it is installed),
    checked: labels, transitions and types are maps of strings, boundaries (labels), only and
    keep (codes) lists of them, actions and types are known. A part that is absent keeps the
    default, others are passed over. ``timeline.tokens``, ``timeline.classified`` and ``encoding`` take the result."""
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            body = yaml.safe_load(f)
        else:
            body = json.load(f)
    body = body or {}
    out = {**C.RULES, **{k: v for k, v in body.items() if k in C.RULES}}
    lists = ("boundaries", "only", "keep")
    if bad := [n for n in lists if isinstance(out[n], str) or not all(isinstance(x, str) for x in out[n])]:
        raise ValueError(f"{bad} must be lists of strings")
    out |= {n: tuple(out[n]) for n in lists}
    for name in ("labels", "transitions", "types"):
        table = out[name]
        if not isinstance(table, dict) or not all(isinstance(x, str) for kv in table.items() for x in kv):
            raise ValueError(f"{name} must map strings to strings")
    if bad := {v for v in out["transitions"].values() if v not in (*C.ACTIVE, "suppress")}:
        raise ValueError(f"unknown actions: {sorted(bad)}")
    if bad := {v for v in out["types"].values() if v not in C.WINDOW_TYPES}:
        raise ValueError(f"unknown window types: {sorted(bad)}")
    return out
