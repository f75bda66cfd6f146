"""Events to token rows: one subject's history as (pos, tok_ord) ordered tokens.

Everything is an expression over one row, but for the clock, which takes windows over
the subject; the whole timeline costs one shuffle by subject_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config as C
from ..functions import numeric as N
from ..functions import routing as R
from ..functions import text as T

FLAGS = ("adm", "tra", "dis", "dea", "edl", "icu", "orl")


def code_rules(codes: DataFrame, rules: dict = C.RULES) -> DataFrame:
    """codes(code) with category, label, action, type_id, site, the transition flags, and solo:
    whether the code is structural only. rules as ``loaders.rules`` reads them."""
    # in a lambda: evaluated by the interpreter, as all rules together are too long for one
    # compiled method; there is a row a distinct code. Exploded: a filter on a rule stays above
    # it, else Spark puts the rules in its place and tests every event with them
    first = F.transform(F.array("code"), lambda c: F.struct(R.category(c).alias("category"), R.structural_label(c, rules).alias("label"), R.transition_action(c, rules).alias("action"), R.prefix(F.upper(c)).alias("p"), R.window_type(c, rules).alias("wtype"), R.structural_only(c, rules).alias("solo")))
    codes = codes.select("code", F.explode(first).alias("r")).select("code", "r.*")
    site = T.bound(F.struct("code", "wtype"), lambda r: F.struct(R.site_name(r["code"], r["wtype"]).alias("site"), R.type_id(r["wtype"]).alias("type_id")))
    p = F.col("p")
    codes = codes.select("code", "category", "label", "action", "wtype", "solo", site.alias("s"), p.isin(*C.ADMISSION_LIKE).alias("adm"), (p == "TRANSFER_TO").alias("tra"), p.isin(*C.DISCHARGE_LIKE).alias("dis"), (p == "MEDS_DEATH").alias("dea"))
    is_type = lambda t: F.coalesce(F.col("wtype") == t, F.lit(False))
    return codes.select("code", "category", "label", "action", "wtype", "solo", "s.type_id", "s.site", "adm", "tra", "dis", "dea", is_type("ED_ADMISSION").alias("edl"), is_type("ICU").alias("icu"), is_type("OR").alias("orl"))


def classified(events: DataFrame, rules: dict = C.RULES, seen: DataFrame | None = None) -> DataFrame:
    """Events with the columns of their code; the rules are evaluated once for each distinct
    code (of seen, if given: the same events before they are shuffled) and joined back. The
    dictionary of codes is broadcast: a join by code would deal all events by few codes."""
    codes = code_rules((events if seen is None else seen).select("code").distinct(), rules)
    return events.join(F.broadcast(codes), events.code.eqNullSafe(codes.code), "left").drop(codes.code)


def _token(kind: str, surface: Column, value: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), surface.alias("surface"), (F.lit(None).cast("double") if value is None else value).alias("value"))


def event_tokens(events: DataFrame) -> DataFrame:
    """Classified events with the array of their tokens, in the order of precedence:
    structural token; nothing more if the event is structural; the category's tokens,
    with an observation pair for measurements without a number."""
    code, cat = F.col("code"), F.col("category")
    surface = F.when(F.col("label").isNotNull(), code).when(cat == "STRUCTURAL", R.prefix(F.upper(code)))
    structural = F.when(surface.isNotNull(), F.array(_token("STRUCT", surface))).otherwise(F.array().cast("array<struct<kind:string,surface:string,value:double>>"))
    base, mark = R.unmarked(code), R.marker(code)
    measured = N.finite(F.col("numeric_value"))
    pair = F.array(_token("OBS_CODE", T.observation_surface(code)), _token("OBS_VALUE", T.code_value(code)))
    none = F.array().cast("array<struct<kind:string,surface:string,value:double>>")
    own = (
        F.when((cat == "MEASUREMENT") & measured, F.array(_token("MEAS", code, F.col("numeric_value"))))
        .when((cat == "MEASUREMENT") & T.observation_surface(code).isNotNull(), pair)
        .when(cat.isin("DIAGNOSIS", "PROCEDURE", "MEDICATION") & mark.isNotNull(), F.array(_token("CODE", base, F.when(cat == "MEDICATION", F.col("numeric_value"))), _token("MARK", mark)))
        .when(cat.isin("DIAGNOSIS", "PROCEDURE", "MEDICATION"), F.array(_token("CODE", base, F.when(cat == "MEDICATION", F.col("numeric_value")))))
        .otherwise(none)
    )
    both = F.when(((cat == "STRUCTURAL") & (F.size(structural) > 0)) | F.col("solo"), structural).otherwise(F.concat(structural, own))
    return events.withColumn("tokens", both)


def tokens(events: DataFrame, rules: dict = C.RULES, seen: DataFrame | None = None) -> DataFrame:
    """The timeline: subject_id, pos, tok_ord, idx (place among the subject's tokens),
    kind, surface, value, category, t_us and dt_us (since the subject's start and since
    the last event that emitted; only an event's first token has it), hook, and the
    transition columns on structural tokens, null elsewhere. Events without time stand
    at 0 and do not move the clock. ``encoding.tokens`` is the same with ids."""
    return clocked(event_tokens(classified(events, rules, seen)), rules=rules)


def clocked(rows: DataFrame, fields: tuple[str, ...] = (), columns: tuple[str, ...] = (), rules: dict = C.RULES) -> DataFrame:
    """The tokens of rows (classified events with an array of them) on the subject's clock,
    with further fields of a token and columns of its event. A token's own hook counts where
    it has the field; else structural tokens are hooked by their label and action."""
    w = W.partitionBy("subject_id").orderBy("pos")
    emitted = F.when(F.size("tokens") > 0, F.col("t_us"))
    start = F.first("t_us", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    last = F.last(emitted, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("rel", F.coalesce(F.greatest(F.col("t_us") - start, F.lit(0)), F.lit(0))).withColumn("gap", F.coalesce(F.greatest(F.col("t_us") - last, F.lit(0)), F.lit(0)))
    out = rows.select("subject_id", "pos", "code", "category", "label", "action", "type_id", "site", *FLAGS, *columns, F.col("t_us").alias("raw_us"), F.col("rel").alias("t_us"), "gap", F.posexplode("tokens").alias("tok_ord", "tok"))
    structural = F.col("tok.kind") == "STRUCT"
    hooked = structural & R.hooked(F.col("label"), F.col("action"), rules)
    if fields:
        hooked = F.col("tok.hook")
    keep = [F.when(structural, F.col(c)).alias(c) for c in ("label", "action", "type_id", "site")] + [(structural & F.col(c)).alias(c) for c in FLAGS]
    token_category = F.when(structural, "STRUCTURAL").otherwise(F.col("category"))
    out = out.select("subject_id", "pos", F.col("tok_ord").cast("long").alias("tok_ord"), F.col("tok.kind").alias("kind"), F.col("tok.surface").alias("surface"), F.col("tok.value").alias("value"), token_category.alias("category"), "raw_us", "t_us", F.when(F.col("tok_ord") == 0, F.col("gap")).otherwise(0).alias("dt_us"), hooked.alias("hook"), *keep, *[F.col(f"tok.{f}").alias(f) for f in fields], *columns)
    return out.withColumn("idx", F.row_number().over(W.partitionBy("subject_id").orderBy("pos", "tok_ord")).cast("long") - 1)


def as_of(events: DataFrame, aliases: tuple[str, ...], anchors: DataFrame) -> DataFrame:
    """subject_id, anchor_us and the latest finite number of a code among aliases at or
    before the anchor; of equal times the later in order."""
    c = R.normal(F.col("code"))
    good = events.where(R.matches_alias(c, aliases) & N.finite(F.col("numeric_value")))
    met = good.join(anchors, "subject_id").where("t_us <= anchor_us")
    return met.groupBy("subject_id", "anchor_us").agg(F.max_by("numeric_value", F.struct("t_us", "pos")).alias("value"))


def anchors(events: DataFrame) -> DataFrame:
    """The first admission of each subject, else its first event."""
    first = F.min(F.when(R.prefix(R.normal(F.col("code"))).isin("HOSPITAL_ADMISSION", "ICU_ADMISSION", "ED_REGISTRATION", "TRANSFER_TO", "ADMISSION"), F.col("t_us")))
    return events.groupBy("subject_id").agg(F.coalesce(first, F.min("t_us")).alias("anchor_us"))
