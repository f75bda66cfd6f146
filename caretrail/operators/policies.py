"""Audits of boundary policies over decoded items: bundles, the windows they make, reports.

All policies are judged in one pass: an item's reasons under each are columns, and the rows of
a policy are cut from them on the timeline's own partitioning (a subject's items under a policy
lie together). What holds for a bundle stands on its rows; nothing is joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config as C
from ..functions import routing as R
from ..functions.numeric import HOUR_US
from .audit import POLICIES

Policy = tuple[str, str]
PLACEMENTS = ("open_next", "close_current")
DEFAULTS: tuple[Policy, ...] = (("current", "open_next"), ("all_structural", "open_next"), ("transition_like_plus_gap", "open_next"))
EVERY: tuple[Policy, ...] = tuple((p, "open_next") for p in POLICIES)
KEY = ("subject_id", "policy", "placement")


def described(items: DataFrame) -> DataFrame:
    """items of ``decode.items`` with label filled in: a variable's name, else category and id."""
    own = F.when(F.col("item_kind") == "observation_bundle", F.concat("category", F.lit("::None"))).when(F.col("item_kind") == "measurement_bundle", F.concat(F.lit("VAR::"), F.col("gid") - C.FAMILY_OFFSETS["measurement_code"])).otherwise(F.concat_ws("::", "category", "gid"))
    return items.withColumn("label", F.coalesce("label", own))


def told(items: DataFrame) -> DataFrame:
    """items (with label, hook, category) with what ``reasons`` reads, worked out once for all
    policies: text, and marked, whether a marker's name stands in it."""
    text = F.upper(F.concat_ws(" | ", F.col("label"), F.when(F.col("hook"), "WINDOW_BOUNDARY").otherwise(""), F.col("category")))
    return items.withColumn("text", text).withColumn("marked", R.has_any(F.col("text"), C.MARKER_PARTS))


def _gap(gap_h: float) -> str:
    return f"gap>={gap_h:g}h"


def reasons(policy: str, gap_h: float, contains: Sequence[str]) -> Column:
    """Why an item (of ``told``, with action, item, dt_us) is a boundary, in order. No function
    of higher order, which Spark would interpret for each item."""
    none = F.array().cast("array<string>")
    if_ = lambda condition, name: F.when(condition, F.array(F.lit(name))).otherwise(none)
    structural = F.col("category") == "STRUCTURAL"
    gap = if_((F.col("item") > 0) & (F.col("dt_us") >= int(gap_h * HOUR_US)), _gap(gap_h))
    moves = if_(structural & F.col("action").isin(*C.ACTIVE), "transition_like")
    marks = if_(F.col("marked"), "marker_like")
    hook, any_ = if_(F.col("hook"), "window_hook"), if_(structural, "structural_any")
    named = [if_(F.contains(F.col("text"), F.lit(n)), f"contains:{n}") for n in contains]
    by = {"current": (hook,), "all_structural": (any_,), "gap_only": (), "structural": (any_,), "transition_like": (moves,), "marker_or_transition": (moves, marks), "custom_contains": tuple(named)}
    base = policy.removesuffix("_plus_gap").removesuffix("_or_gap")
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    found = (*by[base], *((gap,) if policy.endswith("gap") or policy == "gap_only" else ()))
    return F.concat(none, *found)


def judged(items: DataFrame, policies: Sequence[Policy] = EVERY, gap_h: float = 6.0, contains: Sequence[str] = ("ICU",), bundle_gap_h: float = C.BUNDLE_GAP_H, bundle_gap_items: int = C.BUNDLE_GAP_IDX) -> DataFrame:
    """Described items under each policy: bundle (so many have begun), member (whether the item
    is of one), bundle_action, side ("close" or "open" of a member), bundle_reasons, and segment.

    Boundaries close in place and time are one bundle, with what lies between them. A bundle
    with explicit actions follows them; one without opens after a gap, else where the policy
    places it. Where it both closes and opens, items go by their role, neutral ones to the side
    that is open so far, and neither side stays empty if the other has two."""
    each = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(where).alias("placement"), reasons(p, gap_h, contains).alias("reasons")) for p, where in policies])
    opens = F.col("action").isin("open_next", "close_open") & F.col("type_id").isNotNull()
    ahead = W.partitionBy("subject_id").orderBy("item").rowsBetween(0, W.unboundedFollowing)
    rows = items.withColumn("typed", F.first(F.when(opens, F.struct("lo", "type_id")), ignorenulls=True).over(ahead))
    keep = ("subject_id", "item", "category", "label", "action", "t_us", "lo", "hi", "typed")
    # a column of its own: what stands in explode itself is interpreted
    rows = told(rows).select(*keep, each.alias("each")).select(*keep, F.explode("each").alias("p")).select(*keep, "p.policy", "p.placement", "p.reasons")
    hit = F.size("reasons") > 0
    w = W.partitionBy(*KEY).orderBy("item")
    last = F.last(F.when(hit, F.struct("item", "t_us")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumns({"hit": hit, "last": last})
    near = (F.col("item") - F.col("last.item") <= bundle_gap_items) & (F.abs(F.col("t_us") - F.col("last.t_us")) <= int(bundle_gap_h * HOUR_US))
    rows = rows.withColumn("bundle", F.sum(F.when(F.col("hit") & ~F.coalesce(near, F.lit(False)), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    own = W.partitionBy(*KEY, "bundle").orderBy("item")
    all_, before = own.rowsBetween(W.unboundedPreceding, W.unboundedFollowing), own.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({"ends": F.max(F.when(F.col("hit"), F.col("item"))).over(all_), "bundle_reasons": F.array_distinct(F.flatten(F.collect_list(F.when(F.col("hit"), F.col("reasons"))).over(all_)))})
    rows = rows.withColumn("member", (F.col("bundle") > 0) & (F.col("item") <= F.col("ends")))
    has = lambda a: F.max(F.when(F.col("member") & (F.col("action") == a), 1).otherwise(0)).over(all_) == 1
    rows = rows.withColumns({"has_both": has("close_open"), "has_open": has("open_next"), "has_close": has("close_current")})
    gap = F.array_contains("bundle_reasons", F.lit(_gap(gap_h)))
    action = (
        F.when(F.col("has_both") | (F.col("has_open") & F.col("has_close")), "close_open").when(F.col("has_open"), "open_next").when(F.col("has_close"), "close_current")
        .when(gap, "open_next").otherwise(F.col("placement"))
    )
    rows = rows.withColumn("bundle_action", F.when(F.col("bundle") > 0, action))
    opened = F.max(F.when(F.col("member") & (F.col("action") == "open_next"), 1).otherwise(0)).over(before) == 1
    neutral = F.when(F.coalesce(opened, F.lit(False)), "open").otherwise("close")
    both = F.when(F.col("action") == "close_current", "close").when(F.col("action") == "open_next", "open").otherwise(neutral)
    side = F.when(F.col("bundle_action") == "close_current", "close").when(F.col("bundle_action") == "open_next", "open").otherwise(both)
    rows = rows.withColumn("side", F.when(F.col("member"), side))
    n = lambda s: F.sum(F.when(F.col("side") == s, 1).otherwise(0)).over(all_)
    rows = rows.withColumns({"n_open": n("open"), "n_close": n("close"), "begins": F.min("item").over(all_)})
    split = F.col("bundle_action") == "close_open"
    spare = split & (F.col("n_close") == 0) & (F.col("n_open") > 1) & (F.col("item") == F.col("begins"))
    lent = split & (F.col("n_open") == 0) & (F.col("item") == F.col("ends"))
    rows = rows.withColumn("side", F.when(F.col("member"), F.when(spare, "close").when(lent, "open").otherwise(F.col("side"))))
    segment = F.col("bundle") - F.when(F.coalesce(F.col("side") == "close", F.lit(False)), 1).otherwise(0)
    return rows.withColumn("segment", segment).drop("last", "has_both", "has_open", "has_close", "n_open", "n_close", "begins", "hit")


def boundaries(rows: DataFrame) -> DataFrame:
    """One row a bundle of ``judged`` rows: its items lo_item to hi_item, action, label (of the
    first item it opens, else closes), reasons, and the items that it closes and opens."""
    m = rows.where("member")
    of = lambda s: F.sort_array(F.collect_list(F.when(F.col("side") == s, F.col("item"))))
    first = F.min_by("label", F.struct(F.when(F.col("side") == "open", 0).otherwise(1), "item"))
    return m.groupBy(*KEY, "bundle").agg(F.min("item").alias("lo_item"), F.max("item").alias("hi_item"), F.first("bundle_action").alias("action"), first.alias("label"), F.first("bundle_reasons").alias("reasons"), of("close").alias("closing"), of("open").alias("opening"))


def windows(rows: DataFrame, length: int = 128, n_special: int = 0, most: int = C.WINDOW_CAP) -> DataFrame:
    """The windows that the bundles of ``judged`` rows make, ``most`` of a subject under a
    policy: window (from 0), n_items, n_tokens (of the span from its first to its last item),
    n_processed (with specials and markers, at most length), truncated, hours, type_id (of
    the first token in the span that opens one), first and last label and category, and the
    reasons it was opened and closed for."""
    out = _segments(rows)
    room = max(0, length - n_special - 2)
    none = F.array().cast("array<string>")
    return out.where(F.col("window") < most).select(
        *KEY, "window", "n_items", "n_tokens", (F.least(F.col("n_tokens"), F.lit(room)) + n_special + 2).alias("n_processed"), (F.col("n_tokens") > room).alias("truncated"), (F.greatest(F.col("end_us") - F.col("start_us"), F.lit(0)) / HOUR_US).alias("hours"),
        "type_id", "first_label", "first_category", "last_label", "last_category", F.coalesce("opening_reasons", none).alias("opening_reasons"), F.coalesce("closing_reasons", none).alias("closing_reasons"),
    )


def _segments(rows: DataFrame) -> DataFrame:
    """What ``windows`` says of each segment of ``judged`` rows, however many; and label,
    action and reasons of the bundle that it opens with (begun), and of one that only closes
    it (ended), if there is one: of each of ``boundaries`` either, as all but those that only
    close open something."""
    at = lambda c, f: f(c, "item")
    found = lambda when: F.min_by(F.struct("label", F.col("bundle_action").alias("action"), F.col("bundle_reasons").alias("reasons")), F.when(F.col("member") & when, F.col("item")))
    only = F.col("bundle_action") == "close_current"
    # a bundle's reasons stand on the rows it opens, and on those it closes
    opened = F.first(F.when((F.col("bundle") > 0) & (F.col("bundle") == F.col("segment")) & (F.col("bundle_action") != "close_current"), F.col("bundle_reasons")), ignorenulls=True)
    closed = F.first(F.when((F.col("side") == "close") & (F.col("bundle_action") != "open_next"), F.col("bundle_reasons")), ignorenulls=True)
    out = rows.groupBy(*KEY, "segment").agg(
        F.count("*").alias("n_items"), at("lo", F.min_by).alias("lo"), at("hi", F.max_by).alias("hi"), at("t_us", F.min_by).alias("start_us"), at("t_us", F.max_by).alias("end_us"), at(F.struct("typed"), F.min_by).alias("t"),
        *[at(c, f).alias(f"{n}_{c}") for n, f in (("first", F.min_by), ("last", F.max_by)) for c in ("label", "category")], opened.alias("opening_reasons"), closed.alias("closing_reasons"),
        found((F.col("side") == "open") & ~only).alias("begun"), found((F.col("side") == "close") & only).alias("ended"),
    )
    # a bundle with one item only opens: what it closes is known from the window after it
    w = W.partitionBy(*KEY).orderBy("segment")
    out = out.withColumns({"window": F.row_number().over(w).cast("long") - 1, "n_tokens": F.col("hi") - F.col("lo") + 1})
    kind = F.when(F.col("t.typed.lo") <= F.col("hi"), F.col("t.typed.type_id"))
    return out.withColumn("type_id", F.coalesce(kind, F.lit(C.WINDOW_TYPES["UNK"])))


MEASURES = ("n_items", "n_tokens", "n_processed", "hours")


def measures(made: DataFrame) -> DataFrame:
    """policy, placement, measure, windows, p50, p90, p99, largest (nearest rank, from the
    histogram of values, so no list of all windows is held), and the shares of windows of
    unknown type and of truncated ones."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v")) for m in MEASURES])).alias("x")
    flags = (F.col("type_id") == C.WINDOW_TYPES["UNK"]).cast("long"), F.col("truncated").cast("long")
    h = made.select("policy", "placement", flags[0].alias("u"), flags[1].alias("c"), each).groupBy("policy", "placement", "x.measure", "x.v").agg(F.count("*").alias("k"), F.sum("u").alias("u"), F.sum("c").alias("c"))
    own = W.partitionBy("policy", "placement", "measure")
    h = h.withColumns({"upto": F.sum("k").over(own.orderBy("v").rowsBetween(W.unboundedPreceding, 0)), "windows": F.sum("k").over(own)})
    at = lambda q: F.min(F.when(F.col("upto") > F.bround(F.lit(q) * (F.col("windows") - 1)), F.col("v")))
    return h.groupBy("policy", "placement", "measure").agg(F.first("windows").alias("windows"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"), F.max("v").alias("largest"), (F.sum("u") / F.first("windows")).alias("unknown_share"), (F.sum("c") / F.first("windows")).alias("truncated_share"))


def counters(rows: DataFrame, windows: int = C.WINDOW_CAP, most: int = 20) -> DataFrame:
    """policy, placement, counter, name, n and rank: the commonest labels, categories and types
    of the first windows that the bundles of ``judged`` rows make, and reasons, labels and
    actions of all ``boundaries``. Rows are judged once, for both."""

    def named(name, values):
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("counter"), v.cast("string").alias("name")))

    def listed(*columns):
        return F.concat(*[named(n, c if many else F.array(c)) for n, c, many in columns])

    def if_(condition, values):
        return F.when(condition, values).otherwise(F.array().cast("array<struct<counter:string,name:string>>"))

    made = listed(("opening_label", F.col("first_label"), False), ("closing_label", F.col("last_label"), False), ("opening_category", F.col("first_category"), False), ("closing_category", F.col("last_category"), False), ("window_type", F.col("type_id"), False))
    found = lambda b: if_(F.col(b).isNotNull(), listed(("boundary_label", F.col(f"{b}.label"), False), ("boundary_action", F.col(f"{b}.action"), False), ("boundary_reason", F.col(f"{b}.reasons"), True)))
    each = F.explode(F.concat(if_(F.col("window") < windows, made), found("begun"), found("ended"))).alias("x")
    n = _segments(rows).select("policy", "placement", each).groupBy("policy", "placement", "x.counter", "x.name").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("policy", "placement", "counter").orderBy(F.desc("n"), "name"))
    return n.withColumn("rank", rank).where(F.col("rank") <= most)


def previews(rows: DataFrame, k: int, subjects: int) -> DataFrame:
    """Of the first subjects, under each policy of ``judged`` rows, every window with the labels
    of its first and last k items."""
    some = rows.select("subject_id").distinct().orderBy("subject_id").limit(subjects)
    own = W.partitionBy(*KEY, "segment")
    held = rows.join(F.broadcast(some), "subject_id", "left_semi").withColumns({"up": F.row_number().over(own.orderBy("item")), "down": F.row_number().over(own.orderBy(F.desc("item")))})
    held = held.where((F.col("up") <= k) | (F.col("down") <= k))
    of = lambda c: F.transform(F.sort_array(F.collect_list(F.when(F.col(c) <= k, F.struct("item", "label")))), lambda x: x["label"])
    out = held.groupBy(*KEY, "segment").agg(of("up").alias("first_items"), of("down").alias("last_items"))
    return out.withColumn("window", F.row_number().over(W.partitionBy(*KEY).orderBy("segment")).cast("long") - 1).drop("segment")


def marker_usage(rows: DataFrame) -> DataFrame:
    """kind, value and n over the chunks of ``collate.sequences``: how often each window type
    opens a chunk, what ends one (continue, end or next_type), and the marker ids used."""
    n = F.aggregate("mask", F.lit(0), lambda a, x: a + x)
    suffix = F.get("ids", n - 1)
    mode = F.when(suffix == C.CONTINUE_TOKEN, "continue").when(suffix == C.END_TOKEN, "end").otherwise("next_type")
    each = F.explode(F.array(F.struct(F.lit("prefix_type").alias("kind"), F.col("window_type").cast("string").alias("value")), F.struct(F.lit("suffix_mode").alias("kind"), mode.alias("value")), F.struct(F.lit("suffix_id").alias("kind"), suffix.cast("string").alias("value")))).alias("x")
    return rows.select(each).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))
