"""Reports over events and windows: grouped counts, statistics, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config as C
from ..functions import numeric as N
from ..functions import routing as R
from ..functions import text as T
from ..functions.numeric import HOUR_US


def split_counts(index: DataFrame, splits: DataFrame) -> DataFrame:
    """How many index rows each split has; those of none as <missing>."""
    return index.join(splits, "subject_id", "left").groupBy(F.coalesce("split", F.lit("<missing>")).alias("split")).agg(F.count("*").alias("n"))


def _numeric(events: DataFrame) -> DataFrame:
    return events.where(N.finite(F.col("numeric_value")))


def measurement_ids(events: DataFrame, min_count: int) -> DataFrame:
    """code, var_id (from 1, commonest first) and n of numeric measurement codes. The
    numbering is over distinct codes, which are few."""
    k = _numeric(events).where("category = 'MEASUREMENT'").groupBy("code").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    return k.withColumn("var_id", F.row_number().over(W.orderBy(F.desc("n"), "code")).cast("long"))


def _mapped(events: DataFrame, ids: DataFrame) -> DataFrame:
    return _numeric(events).join(ids.select("code", "var_id"), "code")


def variable_stats(events: DataFrame, ids: DataFrame, floor: float = 1e-6) -> DataFrame:
    """Mean and population deviation of each variable, in one pass of sums."""
    v = F.col("numeric_value")
    s = _mapped(events, ids).groupBy("var_id").agg(F.avg(v).alias("mean"), F.avg(v * v).alias("sq"), F.count("*").alias("n"))
    return s.select("var_id", "mean", F.greatest(F.sqrt(F.greatest(F.col("sq") - F.col("mean") * F.col("mean"), F.lit(0.0))), F.lit(floor)).alias("std"), "n")


def stats_with_fallback(events: DataFrame, ids: DataFrame, min_count: int) -> DataFrame:
    """variable_stats, those of all values for variables with fewer than min_count."""
    all_ = _mapped(events, ids).agg(F.avg("numeric_value").alias("gm"), F.stddev_pop("numeric_value").alias("gs"))
    few = F.col("n") < min_count
    return variable_stats(events, ids).join(F.broadcast(all_)).select("var_id", F.when(few, F.col("gm")).otherwise(F.col("mean")).alias("mean"), F.when(few, F.col("gs")).otherwise(F.col("std")).alias("std"))


def coverage(events: DataFrame, ids: DataFrame) -> DataFrame:
    j = _numeric(events).join(ids.select("code", "var_id"), "code", "left")
    return j.agg(F.count("*").alias("numeric_events"), F.count("var_id").alias("mapped"), F.count_if(F.col("var_id").isNull()).alias("unmapped"))


def drop_reasons(events: DataFrame, ids: DataFrame) -> DataFrame:
    """Why events give no value sample: the first reason that holds."""
    j = events.join(ids.select("code", "var_id"), "code", "left")
    v = F.col("numeric_value")
    reason = F.when(F.col("time").isNull(), "no_time").when(F.col("code").isNull(), "no_code").when(F.col("var_id").isNull(), "unknown_code").when(v.isNull(), "no_numeric").when(~N.finite(v), "nonfinite").otherwise("ok")
    return j.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def value_samples(events: DataFrame, ids: DataFrame) -> DataFrame:
    """subject_id, pos, var_id, value and dt_us, the time since the variable's last."""
    w = W.partitionBy("subject_id", "var_id").orderBy("pos")
    return _mapped(events, ids).select("subject_id", "pos", "var_id", F.col("numeric_value").alias("value"), F.coalesce(F.col("t_us") - F.lag("t_us").over(w), F.lit(0)).alias("dt_us"))


def _upto(values: DataFrame, v: str) -> DataFrame:
    """Each distinct value with how many rows do not exceed it (upto), and all rows (total).
    Counts repeat: n rows have at most about the root of twice their sum of distinct ones."""
    h = values.where(F.col(v).isNotNull()).groupBy(v).agg(F.count("*").alias("k"))
    order = W.orderBy(v)
    return h.withColumns({"upto": F.sum("k").over(order.rowsBetween(W.unboundedPreceding, 0)), "total": F.sum("k").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})


def quantiles(values: DataFrame, qs: tuple[float, ...]) -> DataFrame:
    """Nearest-rank quantiles of a column v of counts, from their histogram."""
    h = _upto(values, "v").withColumn("q", F.explode(F.array(*map(F.lit, qs))))
    return h.where(F.col("upto") > F.bround(F.col("q") * (F.col("total") - 1))).groupBy("q").agg(F.min("v").alias("value"))


def at_percentile(counts: DataFrame, p: float) -> DataFrame:
    """Rows whose n reaches the floor-rank percentile of all n."""
    cut = _upto(counts, "n").where(F.col("upto") > F.floor(F.lit(p) * (F.col("total") - 1))).agg(F.min("n").alias("cut"))
    return counts.join(F.broadcast(cut)).where("n >= cut").drop("cut")  # one row


def decision_table(events: DataFrame, min_count: int) -> DataFrame:
    """One row a code: how often, how much of it is captured, and what to do about it."""
    c, cat, u = F.col("code"), F.col("category"), F.upper("code")
    numeric = N.finite(F.col("numeric_value"))
    start, end, stop = u.contains("//START//") | u.startswith("INFUSION_START//"), u.contains("//END//") | u.startswith("INFUSION_END//"), u.contains("//STOP//")
    captured = ((cat == "MEASUREMENT") & numeric) | (cat == "STRUCTURAL") | (cat.isin("DIAGNOSIS", "PROCEDURE") & ~c.contains("//Z"))
    t = events.groupBy("code", "category").agg(F.count("*").alias("events_total"), F.count_distinct("subject_id").alias("subjects_with_code"), F.avg(numeric.cast("double")).alias("numeric_rate"), F.count_if(start).alias("start_like"), F.count_if(end).alias("end_like"), F.count_if(stop).alias("stop_like"), F.count_if(captured).alias("captured_events"), F.max(F.col("label").isNotNull()).alias("in_codebook"))
    t = t.where(F.col("events_total") >= min_count).withColumn("prefix", R.prefix(R.normal(c))).withColumn("capture_rate", F.col("captured_events") / F.col("events_total"))
    t = t.withColumn("reason", F.when(cat == "MEASUREMENT", F.when(F.col("numeric_rate") < 1, "no_numeric_value").otherwise("none")).when(cat == "OTHER", "unrouted").otherwise("code_unmapped"))
    process = (F.col("start_like") > 0) | (F.col("end_like") > 0) | (F.col("stop_like") > 0) | R.has_any(u, ("INFUSION_START", "INFUSION_END", "//START//", "//END//", "//STOP//"))
    measured = F.when((F.col("reason") == "code_unmapped") & (F.col("numeric_rate") >= 0.7), "add_to_measurement_mapping").when(F.col("reason").isin("no_numeric_value", "nonfinite_numeric_value"), "non_numeric_measurement_review").otherwise("measurement_routing_review")
    coded = F.when(process, "move_process_markers_out_of_medtok").when(F.col("capture_rate") < 0.2, "expand_canonicalization_or_vocab").when(F.col("capture_rate") < 0.8, "canonicalization_review").otherwise("covered")
    other = F.when(process, "candidate_transition_or_overlay_signifier").when(F.col("numeric_rate") >= 0.7, "candidate_numeric_reroute").when(R.has_any(u, ("TRANSFER_TO", "ADMISSION", "DISCHARGE", "ED_", "ICU_")), "candidate_structural_reroute").otherwise("likely_low_value_or_admin")
    action = F.when(cat == "MEASUREMENT", measured).when(cat.isin("DIAGNOSIS", "PROCEDURE", "MEDICATION"), coded).when(cat == "STRUCTURAL", F.when(F.col("in_codebook"), "covered_structural").otherwise("add_structural_label_or_boundary_role")).otherwise(other)
    return t.withColumn("suggested_action", action)


def decision_split(table: DataFrame) -> DataFrame:
    a = F.col("suggested_action")
    bucket = F.when(a.isin("covered", "covered_structural"), "immediate").when(a == "likely_low_value_or_admin", "likely_drop").otherwise("manual")
    return table.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("codes"), F.sum("events_total").alias("events"))


def surface(table: DataFrame) -> Column:
    """The surface a code belongs to, for coverage budgets."""
    u, cat = F.upper("code"), F.col("category")
    moves = R.has_any(u, ("TRANSFER_TO", "TRANSFER_FROM", "ADMISSION", "DISCHARGE", "ICU", "ED_", "OR_", "INFUSION_START", "INFUSION_END", "START", "END", "STOP"))
    attribute = R.has_any(u, (" FLUSH", "ROUTE", "FREQ", "FREQUENCY", "FORM", "UNIT", "DOSE", "RATE", "VOLUME"))
    measured = F.when((F.col("reason") == "code_unmapped") & (F.col("numeric_rate") >= 0.7), "measurement_numeric_dense").when(F.col("numeric_rate") >= 0.2, "measurement_numeric_sparse").otherwise("measurement_non_numeric_or_invalid")
    return (
        F.when((cat == "STRUCTURAL") | moves, "structural_transition_overlay").when(cat == "MEASUREMENT", measured)
        .when(cat.isin("DIAGNOSIS", "PROCEDURE", "MEDICATION"), F.when(attribute, "medication_attributes_or_admin").otherwise("medtok_semantic_core"))
        .when(F.col("suggested_action") == "likely_low_value_or_admin", "admin_or_low_value_meta").when(F.col("prefix") == "LAB", "measurement_numeric_sparse").otherwise("other_unclassified")
    )


def surface_summary(table: DataFrame) -> DataFrame:
    s = table.withColumn("surface", surface(table)).groupBy("surface").agg(F.count("*").alias("codes"), F.sum("events_total").alias("events"), F.round(F.avg("capture_rate"), 6).alias("capture"))
    return s.withColumn("share", F.round(F.col("events") / F.sum("events").over(W.partitionBy(F.lit(1))), 6))


def reason_counts(table: DataFrame) -> DataFrame:
    """Reasons as a JSON object for each code, read back and summed."""
    packed = table.select(F.to_json(F.create_map("reason", "events_total")).alias("reasons"))
    return packed.select(F.explode(F.from_json("reasons", "map<string,bigint>")).alias("reason", "k")).groupBy("reason").agg(F.sum("k").alias("n"))


def raw_summary(events: DataFrame) -> DataFrame:
    """Events by category and by prefix, in one scan."""
    e = events.select("category", R.prefix(R.normal(F.col("code"))).alias("p"), N.finite(F.col("numeric_value")).alias("num"))
    g = e.groupingSets([[F.col("category")], [F.col("p")]], "category", "p").agg(F.grouping("category").alias("g"), F.count("*").alias("n"), F.count_if("num").alias("numeric_n"))
    return g.select(F.when(F.col("g") == 0, "category").otherwise("prefix").alias("kind"), F.coalesce("category", "p").alias("key"), "n", "numeric_n")


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many codes two lists share."""
    j = a.withColumn("x", F.lit(1)).join(b.withColumn("y", F.lit(1)), "code", "full")
    both = F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull())
    return j.agg(both.alias("both"), F.count("*").alias("either"), F.round(both / F.count("*"), 6).alias("jaccard"))


def transfer_suffixes(events: DataFrame) -> DataFrame:
    t = events.where(R.prefix(R.normal(F.col("code"))) == "TRANSFER_TO").withColumn("suffix", F.substring("code", F.locate("//", F.col("code")) + 2, F.lit(1 << 20)))
    return t.groupBy("code", "suffix", "wtype", "icu", "orl").agg(F.count("*").alias("n"))


def gate(values: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Each check as a column, and whether all passed."""
    row = values.select(*[c.alias(k) for k, c in checks.items()])
    out = F.lit(True)
    for k in checks:
        out = out & F.col(k)
    return row.withColumn("passed", out)


def window_contract(windows: DataFrame) -> DataFrame:
    none = lambda c: F.coalesce(c, F.lit("none"))
    return windows.groupBy("type_id", none("opening_action").alias("opening"), none("closing_action").alias("closing")).agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"), F.count_distinct("subject_id").alias("subjects"), F.count_if(F.col("n_tokens") <= 2).alias("micro"))


def neighbours(windows: DataFrame, type_id: int) -> DataFrame:
    """Types before and after windows of a type."""
    w = W.partitionBy("subject_id").orderBy("window_ord")
    return windows.withColumn("prev", F.lag("type_id").over(w)).withColumn("next", F.lead("type_id").over(w)).where(F.col("type_id") == type_id).groupBy("prev", "next").agg(F.count("*").alias("n"))


def policies(tokens: DataFrame, gap_h: float = 6.0) -> DataFrame:
    """Windows under other boundary policies: how many, and percentiles of their size."""
    w = W.partitionBy("subject_id").orderBy("idx")
    moves = F.coalesce(F.col("action").isin(*C.ACTIVE), F.lit(False))
    gap = F.coalesce(F.col("t_us") - F.lag("t_us").over(w) >= int(gap_h * HOUR_US), F.lit(False))
    rules = {"transition": moves, "structural": F.col("category") == "STRUCTURAL", "transition_or_gap": moves | gap}
    rows = tokens.select("subject_id", "idx", F.array(*[F.struct(F.lit(k).alias("policy"), v.alias("starts")) for k, v in rules.items()]).alias("p")).select("subject_id", "idx", F.explode("p").alias("p")).select("subject_id", "idx", "p.policy", "p.starts")
    own = W.partitionBy("subject_id", "policy").orderBy("idx")
    rows = rows.withColumn("w", F.sum(F.when((F.col("idx") == 0) | F.col("starts"), 1).otherwise(0)).over(own.rowsBetween(W.unboundedPreceding, 0)))
    sizes = rows.groupBy("policy", "subject_id", "w").agg(F.count("*").cast("double").alias("n"))
    # sizes repeat: ranks come from their histogram, not from a list of all windows
    hist = sizes.groupBy("policy", "n").agg(F.count("*").alias("k"))
    order = W.partitionBy("policy").orderBy("n")
    hist = hist.withColumn("upto", F.sum("k").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("windows", F.sum("k").over(W.partitionBy("policy")))
    at = lambda q: F.min(F.when(F.col("upto") > F.bround(F.lit(q) * (F.col("windows") - 1)), F.col("n")))
    return hist.groupBy("policy").agg(F.first("windows").alias("windows"), at(0.5).alias("p50"), at(0.9).alias("p90"), F.max("n").alias("largest"))


def rank_stats(chosen: DataFrame, ranked: DataFrame) -> DataFrame:
    """Where chosen(code) stand in ranked(code, n), commonest first."""
    r = ranked.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "code")).cast("long"))
    m = r.join(chosen.select("code"), "code", "left_semi")
    return m.agg(F.count("*").alias("matched"), F.round(F.avg("rank"), 6).alias("mean_rank"), F.percentile("rank", F.lit(0.5)).alias("median_rank"), F.min("rank").alias("min_rank"), F.max("rank").alias("max_rank"))


def error_metrics(pairs: DataFrame, min_count: int) -> DataFrame:
    """var_id, n, mae and rmse of pairs(var_id, value, predicted), worst first by mae."""
    e = F.col("value") - F.col("predicted")
    m = pairs.groupBy("var_id").agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))
    return m.where(F.col("n") >= min_count)


def thresholds(counts: DataFrame, limits: tuple[int, ...]) -> DataFrame:
    """How many of counts(n) each limit is not below, and their share."""
    t = counts.select("n", F.explode(F.array(*map(F.lit, limits))).alias("limit"))
    return t.groupBy("limit").agg(F.count_if(F.col("n") <= F.col("limit")).alias("codes"), F.round(F.avg((F.col("n") <= F.col("limit")).cast("double")), 6).alias("share"))


def stats_by_id(stats: DataFrame, n_ids: int) -> DataFrame:
    """Variable statistics of all ids from 1 to n_ids; (0, 1, 0) for those without values."""
    ids = stats.sparkSession.range(1, n_ids + 1).withColumnRenamed("id", "var_id")
    s = ids.join(stats, "var_id", "left")
    return s.select("var_id", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("std", F.lit(1.0)).alias("std"), F.coalesce("n", F.lit(0)).alias("n"))


def worst(metrics: DataFrame, by: str, k: int) -> DataFrame:
    return metrics.orderBy(F.desc(by), "var_id").limit(k)


def examples(rows: DataFrame, bucket: str, k: int, *order: str) -> DataFrame:
    """The first k rows of each bucket."""
    return rows.withColumn("nth", F.row_number().over(W.partitionBy(bucket).orderBy(*order))).where(F.col("nth") <= k)


def worst_codes(table: DataFrame, k: int) -> DataFrame:
    """Codes of a decision table by events that were missed, then by subjects and events."""
    return table.withColumn("uncaptured_events", F.col("events_total") - F.col("captured_events")).orderBy(F.desc("uncaptured_events"), F.desc("subjects_with_code"), F.desc("events_total"), "code").limit(k)


def token_flow(events: DataFrame, tokens: DataFrame) -> DataFrame:
    """Of each subject its events, those that gave tokens or none, tokens by kind, and how
    many events gave one, two or more tokens. events are classified."""
    sizes = tokens.groupBy("subject_id", "pos").agg(F.count("*").alias("size"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("STRUCT", "MEAS", "OBS_CODE", "CODE", "MARK")])
    t = sizes.groupBy("subject_id").agg(F.count("*").alias("emitted"), F.sum("size").alias("tokens"), F.count_if(F.col("size") == 1).alias("single"), F.count_if(F.col("size") == 2).alias("pairs"), F.count_if(F.col("size") > 2).alias("larger"), *[F.sum(k).alias(k.lower()) for k in ("STRUCT", "MEAS", "OBS_CODE", "CODE", "MARK")])
    e = events.groupBy("subject_id").agg(F.count("*").alias("events"), F.count_if(F.col("category") == "OTHER").alias("unrouted"))
    names = [c for c in t.columns if c != "subject_id"]
    return e.join(t, "subject_id", "left").select("subject_id", "events", "unrouted", *[F.coalesce(c, F.lit(0)).alias(c) for c in names]).withColumn("dropped", F.col("events") - F.col("emitted"))


def outcomes(resolved: DataFrame) -> DataFrame:
    """Of each coded category its codes and events, mapped ones (not by hash), and their
    rate. resolved is what ``vocab.resolve`` returns."""
    r = resolved.groupBy("category").agg(F.sum("n").alias("events"), F.sum(F.when(F.col("stage") != "residual_hash", F.col("n")).otherwise(0)).alias("mapped"), F.count("*").alias("codes"))
    return r.withColumn("mapped_rate", F.round(F.col("mapped") / F.col("events"), 6))


def matching(codes: DataFrame, resolved: DataFrame, vocab: DataFrame) -> DataFrame:
    """Of each coded category, by events: filtered (its filter would keep the code), routed,
    both, mismatched (filtered, but routed to no coded category), hits, misses, and each
    stage; and how many entries of the vocabulary were met, and their share.

    codes(code, category, n) are all codes, resolved is what ``vocab.resolve`` returns for the
    coded ones. Everything is summed over distinct codes."""
    tests = {"DIAGNOSIS": T.is_diagnosis, "PROCEDURE": T.is_procedure, "MEDICATION": T.is_medication}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("of"), F.coalesce(f(F.col("code")), F.lit(False)).alias("kept")) for k, f in tests.items()])).alias("x")
    rows = codes.where("code is not null").select("code", "category", "n", each).select("code", "category", "n", "x.of", "x.kept")
    own, coded = F.col("category") == F.col("of"), F.col("category").isin(*tests)
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    routed = rows.groupBy(F.col("of").alias("category")).agg(total(F.col("kept")).alias("filtered"), total(own).alias("routed"), total(own & F.col("kept")).alias("filtered_routed"), total(F.col("kept") & ~coded).alias("mismatched"))
    stages = ("exact", "canonicalized", "parent_lookup", "crosswalk_lookup", "lexical_bridge", "residual_exact", "residual_hash", "unk")
    met = F.col("stage").isin(*stages[:5])
    found = resolved.groupBy("category").agg(total(~F.col("stage").isin("residual_hash", "unk")).alias("hits"), total(F.col("stage").isin("residual_hash", "unk")).alias("misses"), *[total(F.col("stage") == x).alias(f"stage_{x}") for x in stages], F.count_distinct(F.when(met, F.col("hit"))).alias("entries_met"))
    size = vocab.groupBy("category").agg(F.count("*").alias("entries"))
    out = routed.join(found, "category", "left").join(size, "category", "left")
    return out.withColumn("entries_share", F.col("entries_met") / F.col("entries"))


def leading(tokens: DataFrame) -> DataFrame:
    """Of each subject how many tokens, and clinical ones, stand before its first transition."""
    first = F.min(F.when(F.col("action").isin(*C.ACTIVE), F.col("idx"))).over(W.partitionBy("subject_id"))
    before = F.col("first").isNull() | (F.col("idx") < F.col("first"))
    return tokens.withColumn("first", first).groupBy("subject_id").agg(F.count_if(before).alias("tokens"), F.count_if(before & F.col("category").isin(*C.CLINICAL)).alias("clinical"), F.max(F.col("first").isNotNull()).alias("has_transition"))


def bundle_prefixes(bundled: DataFrame) -> DataFrame:
    """Prefixes that occur in bundles(subject_id, bundle, surface, action), by action."""
    p = R.prefix(F.upper("surface"))
    return bundled.groupBy(p.alias("prefix"), "action").agg(F.count("*").alias("n"), F.count_distinct("subject_id", "bundle").alias("bundles"), F.count_distinct("subject_id").alias("subjects"))


def bundle_pairs(bundled: DataFrame) -> DataFrame:
    """Pairs of distinct prefixes that share a bundle. A bundle has few prefixes: its pairs
    are made of its own set, not of a join."""
    s = bundled.groupBy("subject_id", "bundle").agg(F.sort_array(F.collect_set(R.prefix(F.upper("surface")))).alias("s"))
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return s.select(F.explode(pairs).alias("x")).groupBy("x.a", "x.b").agg(F.count("*").alias("n"))


POLICIES = ("current", "all_structural", "gap_only", "current_plus_gap", "structural_or_gap", "transition_like", "transition_like_plus_gap", "marker_or_transition", "marker_or_transition_plus_gap", "custom_contains", "custom_contains_plus_gap")


def boundary_reasons(gap_h: float, contains: tuple[str, ...]) -> dict[str, Column]:
    """Each policy's test whether a token (with item_gap, the time since the one before) is
    a boundary."""
    text = F.upper(F.concat_ws(" | ", F.col("surface"), F.when(F.col("hook"), "HOOK").otherwise(""), F.col("category")))
    gap = F.coalesce(F.col("item_gap") >= int(gap_h * HOUR_US), F.lit(False))
    hook, structural = F.col("hook"), F.col("category") == "STRUCTURAL"
    moves = structural & F.coalesce(F.col("action").isin(*C.ACTIVE), F.lit(False))
    marks, named = R.has_any(text, C.MARKER_PARTS), R.has_any(text, contains)
    tests = (hook, structural, gap, hook | gap, structural | gap, moves, moves | gap, moves | marks, moves | marks | gap, named, named | gap)
    return dict(zip(POLICIES, tests, strict=True))


def policy_measures(tokens: DataFrame, gap_h: float = 6.0, contains: tuple[str, ...] = ("ICU",)) -> DataFrame:
    """Under each of the eleven policies: boundaries (close candidates count as one),
    windows, and percentiles of their tokens and hours (nearest rank, from histograms)."""
    w = W.partitionBy("subject_id").orderBy("idx")
    rows = tokens.withColumn("item_gap", F.when(F.col("idx") > 0, F.col("dt_us")))
    tests = boundary_reasons(gap_h, contains)
    rows = rows.select("subject_id", "idx", "t_us", F.explode(F.array(*[F.struct(F.lit(k).alias("policy"), v.alias("hit")) for k, v in tests.items()])).alias("p")).select("subject_id", "idx", "t_us", "p.policy", "p.hit")
    own = W.partitionBy("subject_id", "policy").orderBy("idx")
    last = F.last(F.when(F.col("hit"), F.struct("idx", "t_us")), ignorenulls=True).over(own.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("last", last)
    near = (F.col("idx") - F.col("last.idx") <= C.BUNDLE_GAP_IDX) & (F.abs(F.col("t_us") - F.col("last.t_us")) <= int(C.BUNDLE_GAP_H * HOUR_US))
    rows = rows.withColumn("bound", F.col("hit") & ~F.coalesce(near, F.lit(False)))
    rows = rows.withColumn("w", F.sum(F.when((F.col("idx") == 0) | F.col("bound"), 1).otherwise(0)).over(own.rowsBetween(W.unboundedPreceding, 0)))
    sizes = rows.groupBy("policy", "subject_id", "w").agg(F.count("*").cast("double").alias("tokens"), (F.floor((F.max("t_us") - F.min("t_us")) / HOUR_US)).cast("double").alias("hours"), F.max("bound").alias("bound"))
    long = sizes.select("policy", F.explode(F.array(F.struct(F.lit("tokens").alias("measure"), F.col("tokens").alias("v")), F.struct(F.lit("hours").alias("measure"), F.col("hours").alias("v")))).alias("x"), "bound").select("policy", "x.measure", "x.v", "bound")
    hist = long.groupBy("policy", "measure", "v").agg(F.count("*").alias("k"), F.count_if("bound").alias("b"))
    order = W.partitionBy("policy", "measure").orderBy("v")
    hist = hist.withColumns({"upto": F.sum("k").over(order.rowsBetween(W.unboundedPreceding, 0)), "windows": F.sum("k").over(W.partitionBy("policy", "measure"))})
    at = lambda q: F.min(F.when(F.col("upto") > F.bround(F.lit(q) * (F.col("windows") - 1)), F.col("v")))
    return hist.groupBy("policy", "measure").agg(F.first("windows").alias("windows"), F.sum("b").alias("boundaries"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"), F.max("v").alias("largest"))


def surface_paths(table: DataFrame) -> DataFrame:
    """Where the codes of each surface go."""
    s = table.withColumn("surface", surface(table))
    return s.groupBy("surface", F.coalesce(R.lookup(C.SURFACE_PATHS, F.col("surface")), F.lit("Manual review")).alias("path")).agg(F.count("*").alias("codes"))


def unique_subjects(splits: DataFrame) -> DataFrame:
    """splits, if no subject has two rows; else an error when it is read."""
    n = F.count("*").over(W.partitionBy("subject_id"))
    checked = splits.withColumn("n", n)
    return checked.where(F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("subject in two rows: "), F.col("subject_id")))).otherwise(F.lit(True))).drop("n")
