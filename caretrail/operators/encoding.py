"""Events to token ids: the encoders of all families, as one table of codes and one step.

Whatever follows from a code alone (routing, structural role, resolution, observation pair,
unknown ids, whether it must leave a boundary) is worked out once for each distinct code, in
``dictionary``. ``encoded`` joins that table to the events and expands each one to its tokens,
in the order of precedence; ``timeline.tokens`` puts them on the clock. Only a measurement's
value ids depend on the event.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import numeric as N
from ..functions import routing as R
from ..functions import text as T
from . import timeline, vocab

MARKS = ("START", "END", "STOP")
TOKEN = "struct<kind:string,surface:string,value:double,gid:bigint,level:int,exact:boolean,hook:boolean>"
_FAMILY_OF = {"DIAGNOSIS": "diagnosis", "PROCEDURE": "procedure", "MEDICATION": "medication"}


class Encoders(NamedTuple):
    """What turns codes into ids. Ids of a table count from 1; 0 stands for unknown.

    measurements(code, var_id, mean, std); structural(entry, raw_id); resolved(category, code,
    stage, gid) as ``vocab.resolve`` returns it (codes it lacks have no token); observation
    codes and values (surface, raw_id). codes gives the ids of a standardised value, level by
    level, as an array column. attributes: name of a column of the events: its values' ids;
    numbers: names of columns with a scale in ``config.NUMERIC_BINS``.
    """

    measurements: DataFrame
    structural: DataFrame
    resolved: DataFrame
    codes: Callable[[Column], Column]
    levels: int
    stride: int
    observation_codes: DataFrame | None = None
    observation_values: DataFrame | None = None
    tail: str = "hash"
    codebook: bool = True
    boundaries: DataFrame | None = None
    process: bool = False
    keep_process_codes: bool = True
    attributes: dict[str, dict[str, int]] = {}
    numbers: tuple[str, ...] = ()
    rules: dict = C.RULES


def carved(offsets: dict[str, int], largest: dict[str, int], buckets: int) -> dict[str, int | None]:
    """Where each coded family's residual ids begin, in the slack behind its vocabulary: a
    thousand ids after its largest local one, if all buckets fit before the next family; else
    None. offsets: of diagnosis, procedure, medication and structural."""
    order = ("diagnosis", "procedure", "medication", "structural")
    out: dict[str, int | None] = {}
    for name, following in zip(order, order[1:]):
        start = offsets[name] + largest.get(name, 0) + 1000
        out[name] = start if start + buckets < offsets[following] else None
    return out


def structural_vocab(events: DataFrame) -> DataFrame:
    """entry and raw_id of the structural surfaces of classified events, in order. They are a
    code book's codes and prefixes: a short list, however many events."""
    return vocab.numbered(_surfaces(events).where("entry is not null").select(F.lit("STRUCTURAL").alias("category"), "entry").distinct()).select("entry", "raw_id")


def _surfaces(codes: DataFrame) -> DataFrame:
    code = F.col("code")
    return codes.withColumn("entry", F.when(F.col("label").isNotNull(), code).when(F.col("category") == "STRUCTURAL", R.prefix(F.upper(code))))


def dictionary(events: DataFrame, enc: Encoders) -> DataFrame:
    """One row a distinct code of events: its rules and everything its tokens are made of."""
    at = C.FAMILY_OFFSETS
    d = _surfaces(timeline.code_rules(events.select("code").distinct(), enc.rules))
    code = F.col("code")
    d = d.join(enc.structural.select("entry", F.col("raw_id").alias("struct_id")), "entry", "left").withColumnRenamed("entry", "struct_surface")
    d = d.withColumn("struct_gid", F.when(F.col("struct_surface").isNotNull(), F.coalesce("struct_id", F.lit(0)) + at["structural"])).drop("struct_id")
    d = d.join(enc.resolved.select("category", "code", "stage", F.col("gid").alias("base_gid")), ["category", "code"], "left")
    d = d.join(enc.measurements.select("code", "var_id", "mean", "std"), "code", "left")
    d = d.withColumns({"obs_code": F.when(F.col("category") == "MEASUREMENT", T.observation_surface(code)), "obs_value": F.when(F.col("category") == "MEASUREMENT", T.code_value(code))})
    for name, table in (("code", enc.observation_codes), ("value", enc.observation_values)):
        if table is not None:
            d = d.join(table.select(F.col("surface").alias(f"obs_{name}"), F.col("raw_id").alias(f"{name}_id")), f"obs_{name}", "left")
        else:
            d = d.withColumn(f"{name}_id", F.lit(None).cast("long"))
    known = F.lit(True)
    if enc.tail == "drop":
        known = (F.col("code_id").isNotNull() if enc.observation_codes is not None else known) & (F.col("value_id").isNotNull() if enc.observation_values is not None else known)
    observed = F.col("obs_code").isNotNull() & known
    lane = at["observation_value"] - at["observation_code"] - 1
    reserved = R.lookup({k: str(v) for k, v in C.OBSERVATION_VALUES.items()}, F.upper("obs_value")).cast("long")
    d = d.withColumns({
        "obs_code_gid": F.when(observed, F.coalesce("code_id", N.hash_lane(F.col("obs_code"), lane)) + at["observation_code"]),
        "obs_value_gid": F.when(observed, F.coalesce("value_id", reserved, N.hash_lane(F.concat(F.lit("OBS_VAL::"), F.col("obs_value")), C.OBSERVATION_VALUE_LANE)) + at["observation_value"]),
        "code_exact": F.col("code_id").isNotNull(), "value_exact": F.col("value_id").isNotNull(),
    })
    coded = F.col("category").isin(*_FAMILY_OF)
    unknown = R.lookup({k: str(at[v]) for k, v in _FAMILY_OF.items()}, F.col("category")).cast("long")
    d = d.withColumns({"unk_gid": F.coalesce(unknown, F.when(F.col("category") == "STRUCTURAL", at["structural"]), F.lit(0)), "base": F.when(coded, R.unmarked(code)), "mark": F.when(coded, R.marker(code))})
    active, label = F.coalesce(F.col("action").isin(*C.ACTIVE), F.lit(False)), F.col("label")
    if enc.codebook:
        d = d.withColumns({"hook_struct": R.hooked(label, F.col("action"), enc.rules), "hook_event": label.isNull() & (F.col("category") == "STRUCTURAL") & active})
    elif enc.boundaries is not None:
        named = enc.boundaries.select("code").distinct().withColumn("named", F.lit(True))
        d = d.join(named, "code", "left").withColumns({"hook_struct": F.coalesce("named", F.lit(False)), "hook_event": F.coalesce("named", F.lit(False))}).drop("named")
    else:
        legacy = R.prefix(F.upper(code)).isin(*C.LEGACY_BOUNDARIES)
        d = d.withColumns({"hook_struct": F.coalesce(legacy, F.lit(False)), "hook_event": F.coalesce(legacy & (F.col("category") == "STRUCTURAL"), F.lit(False))})
    if enc.process:
        d = d.join(_process(d.select("code")), "code", "left")
    return d.drop("code_id", "value_id", "wtype", "p")


def _process(codes: DataFrame) -> DataFrame:
    """code, action_gid and entity_gid of codes that begin or end a process."""
    from . import ids

    rows = ids.process_ids(codes.select(F.col("code").alias("subject_id"), F.lit(0).alias("pos"), "code"))
    return rows.select(F.col("subject_id").alias("code"), "action_gid", "entity_gid")


def _token(kind: str, gid: Column, surface: Column, value: Column | None = None, level: Column | None = None, exact: Column | None = None, hook: Column | None = None) -> Column:
    none = F.lit(None)
    parts = (F.lit(kind), surface, none.cast("double") if value is None else value.cast("double"), gid.cast("long"), none.cast("int") if level is None else level.cast("int"), F.lit(True) if exact is None else exact, F.lit(False) if hook is None else hook)
    return F.struct(*parts).cast(TOKEN)


def _with_codes(events: DataFrame, table: DataFrame) -> DataFrame:
    # broadcast: a join by code would deal all events by few codes
    named = table.withColumnRenamed("code", "_code")
    return events.join(F.broadcast(named), F.col("code").eqNullSafe(F.col("_code")), "left").drop("_code")


def _standardised() -> tuple[Column, Column]:
    """Whether an event is a measurement that is encoded, and its standardised value."""
    c = F.col
    measured = (c("category") == "MEASUREMENT") & N.finite(c("numeric_value")) & (c("var_id") > 0)
    return measured, F.when(measured, N.z_score(c("numeric_value"), c("mean"), c("std")))


def valued(events: DataFrame, table: DataFrame, enc: Encoders) -> DataFrame:
    """Events with value_codes, a measurement's ids level by level. ``encoded`` adds them to
    events that lack them; but ``codes`` may be a Python function, behind which Spark knows
    nothing of the partitioning, so events that are dealt by subject have them before that."""
    e = _with_codes(events, table.select("code", "category", "var_id", "mean", "std"))
    return e.withColumn("value_codes", enc.codes(_standardised()[1])).drop("category", "var_id", "mean", "std")


def encoded(events: DataFrame, table: DataFrame, enc: Encoders) -> DataFrame:
    """Events with the columns of their code and the array ``tokens``: process pair if asked
    for; structural token; nothing more if that makes up the event; else what its family's
    encoder gives, an observation pair for measurements it can't encode, and an unknown token
    where a boundary must not be lost."""
    e = _with_codes(events if "value_codes" in events.columns else valued(events, table, enc), table)
    at, c = C.FAMILY_OFFSETS, F.col
    none = F.array().cast(f"array<{TOKEN}>")
    value, cat = c("numeric_value"), c("category")
    measured, z = _standardised()
    e = e.withColumn("z", z)
    pair = F.array(_token("PROCESS_ACTION", c("action_gid"), c("code")), _token("PROCESS_ENTITY", c("entity_gid"), c("code"))) if enc.process else none
    in_process = c("action_gid").isNotNull() if enc.process else F.lit(False)
    pair = F.when(in_process, pair).otherwise(none)
    struct = F.when(c("struct_gid").isNotNull(), F.array(_token("STRUCT", c("struct_gid"), c("struct_surface"), hook=c("hook_struct")))).otherwise(none)
    levels = F.transform("value_codes", lambda x, i: _token("VALUE", F.lit(at["measurement_value"]) + i * enc.stride + x, c("code"), level=i))
    rated = F.concat(F.array(_token("MEAS", c("var_id") + at["measurement_code"], c("code"), c("z"))), levels)
    observed = F.array(_token("OBS_CODE", c("obs_code_gid"), c("obs_code"), exact=c("code_exact")), _token("OBS_VALUE", c("obs_value_gid"), c("obs_value"), exact=c("value_exact")))
    numeric = F.when((cat == "MEDICATION") & N.finite(value), value)
    coded = F.array(_token("CODE", c("base_gid"), c("base"), numeric, exact=c("stage") != "residual_hash"))
    marked = F.array(_token("MARK", c("unk_gid"), c("mark"), numeric))
    own = (
        F.when(measured, rated).when((cat == "MEASUREMENT") & c("obs_code_gid").isNotNull(), observed)
        .when(cat.isin(*_FAMILY_OF) & c("base_gid").isNotNull() & c("mark").isNotNull(), F.concat(coded, marked))
        .when(cat.isin(*_FAMILY_OF) & c("base_gid").isNotNull(), coded).otherwise(none)
    )
    fallback = F.array(_token("UNK", c("unk_gid"), c("code")))
    own = F.when((F.size(own) == 0) & c("hook_event"), fallback).otherwise(own)
    own = F.transform(own, lambda t, i: t.withField("hook", t["hook"] | c("hook_event")))
    first = F.concat(pair, struct)
    alone = (F.size(first) > 0) & ((cat == "STRUCTURAL") | c("solo") | (F.lit(not enc.keep_process_codes) & in_process))
    e = e.withColumn("tokens", F.when(alone, first).otherwise(F.concat(first, own)))
    given = F.map_from_arrays(F.array(*map(F.lit, enc.attributes)), F.array(*[F.coalesce(R.lookup({k: str(i) for k, i in ids.items()}, c(n)).cast("int"), F.lit(0)) for n, ids in enc.attributes.items()])) if enc.attributes else None
    if given is not None:
        e = e.withColumn("cat_attrs", F.when(cat == "MEDICATION", given))
    if enc.numbers:
        e = e.withColumn("num_attrs", F.when(cat == "MEDICATION", F.map_from_arrays(F.array(*map(F.lit, enc.numbers)), F.array(*[F.coalesce(N.bin_share(c(n), n), F.lit(0.0)) for n in enc.numbers]))))
    return e.drop("z", "value_codes")


def tokens(events: DataFrame, table: DataFrame, enc: Encoders) -> DataFrame:
    """The timeline with ids: the columns of ``timeline.tokens`` and gid, level (of a value
    id), exact (whether the id stands for the code itself), and cat_attrs and num_attrs of
    medications if the encoders name attributes."""
    more = [n for n, on in (("cat_attrs", enc.attributes), ("num_attrs", enc.numbers)) if on]
    return timeline.clocked(encoded(events, table, enc), ("gid", "level", "exact"), tuple(more))
