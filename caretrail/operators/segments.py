"""Token timelines cut into bundles, windows, chunks and trajectories.

The sequential rules become lags and running sums over (subject_id, idx). Every column is a
window function over the subject, or a part of its history, so the whole segmentation stays
on the timeline's own partitioning: it adds no shuffle and joins nothing. What holds for a
bundle or a window stands on each of its rows. The one fold is the greedy packing of chunks.

A subject's history is one window partition: that is the unit the rules are defined on, and
the longest history bounds a task (Spark's windows spill, so it need not fit in memory).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config as C
from ..functions.numeric import HOUR_US


def _subject():
    return W.partitionBy("subject_id")


def _so_far():
    return _subject().orderBy("idx").rowsBetween(W.unboundedPreceding, 0)


def _before():
    return _subject().orderBy("idx").rowsBetween(W.unboundedPreceding, -1)


def _counted(test: Column) -> Column:
    return F.sum(F.when(test, 1).otherwise(0))


_UNK, _POST = C.WINDOW_TYPES["UNK"], C.WINDOW_TYPES["POST_DISCHARGE"]
_OPENS = "struct<type:int,w_site:string,bundle_action:string,open_us:bigint>"
_CLOSES = "struct<action:string,us:bigint,discharge:boolean>"


def _bundled(tokens: DataFrame) -> DataFrame:
    """All tokens with cand (whether it is a transition), the candidate before it (p_idx,
    p_t, p_clinical), clinical (so many clinical tokens up to here) and bundle."""
    rows = tokens.withColumn("cand", F.coalesce(F.col("action").isin(*C.ACTIVE), F.lit(False)))
    rows = rows.withColumn("clinical", _counted(F.col("category").isin(*C.CLINICAL)).over(_so_far()))
    last = F.last(F.when(F.col("cand"), F.struct("idx", "t_us", "clinical")), ignorenulls=True).over(_before())
    rows = rows.withColumn("p", last).select("*", F.col("p.idx").alias("p_idx"), F.col("p.t_us").alias("p_t"), F.col("p.clinical").alias("p_clinical")).drop("p")
    apart = (F.col("idx") - F.col("p_idx") > C.BUNDLE_GAP_IDX) | (F.abs(F.col("t_us") - F.col("p_t")) > int(C.BUNDLE_GAP_H * HOUR_US))
    return rows.withColumn("bundle", _counted(F.col("cand") & apart).over(_so_far()))


def bundles(tokens: DataFrame) -> DataFrame:
    """Candidate tokens with bundle: those close in index and in time belong together."""
    return _bundled(tokens).where("cand").drop("cand", "p_idx", "p_t", "p_clinical")


def _chained(tokens: DataFrame) -> DataFrame:
    """_bundled with merged: bundles joined where a transition goes on."""
    rows = _bundled(tokens)
    of_bundle = W.partitionBy("subject_id", "bundle")
    any_ = lambda c: F.max(F.when(F.col("cand"), F.col(c))).over(of_bundle)
    rows = rows.withColumns({"b_adm": any_("adm"), "b_dis": any_("dis"), "b_dea": any_("dea"), "b_lo": F.min(F.when(F.col("cand"), F.col("idx"))).over(of_bundle)})
    rows = rows.withColumn("head", F.col("cand") & (F.col("idx") == F.col("b_lo")))
    brk = F.col("p_idx").isNull() | F.col("b_dis") | F.col("b_dea") | (F.col("idx") - F.col("p_idx") - 1 > C.CHAIN_TOKENS) | (F.col("clinical") - F.col("p_clinical") > 0) | (F.col("t_us") - F.col("p_t") > int(C.CHAIN_GAP_H * HOUR_US))
    rows = rows.withColumn("brk", F.col("head") & brk)
    rows = rows.withColumn("chain", _counted(F.col("brk")).over(_so_far()))
    chain = W.partitionBy("subject_id", "chain").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    later = F.col("head") & ~F.col("brk") & F.col("b_adm")
    rows = rows.withColumns({"open_end": F.first(F.when(F.col("cand"), F.col("b_dis") & ~F.col("b_dea")), ignorenulls=True).over(chain), "nth": _counted(later).over(chain)})
    split = F.col("brk") | (F.col("open_end") & later & (F.col("nth") == 1))
    rows = rows.withColumn("merged", _counted(F.col("head") & split).over(_so_far()) - 1)
    return rows.drop("p_idx", "p_t", "p_clinical", "clinical", "b_adm", "b_dis", "b_dea", "b_lo", "head", "brk", "chain", "open_end", "nth")


def chains(tokens: DataFrame) -> DataFrame:
    """Candidate tokens with bundle and merged."""
    return _chained(tokens).where("cand").drop("cand")


def _merged(tokens: DataFrame, site_change: bool = True) -> DataFrame:
    """_chained with m: what is known of each merged bundle, on its candidates."""
    rows = _chained(tokens)
    own = W.partitionBy("subject_id", "merged")
    if_cand = lambda test, c: F.when(F.col("cand") & test, c)
    yes, idx = F.lit(True), F.col("idx")
    opens, closes = F.col("action").isin("open_next", "close_open"), F.col("action").isin("close_current", "close_open")
    rows = rows.withColumns({
        "lo": F.min(if_cand(yes, idx)).over(own), "hi": F.max(if_cand(yes, idx)).over(own), "t_lo": F.min_by("t_us", if_cand(yes, idx)).over(own),
        "first_tra": F.min(if_cand(F.col("tra"), idx)).over(own), "first_open": F.min(if_cand(opens, idx)).over(own), "closes": F.max(if_cand(yes, closes.cast("int"))).over(own),
    })
    action = F.when(F.col("first_tra").isNotNull() | (F.col("first_open").isNotNull() & (F.col("closes") == 1)), "close_open").when(F.col("first_open").isNotNull(), "open_next").otherwise("close_current")
    rows = rows.withColumn("bundle_action", action)
    rows = rows.withColumn("turn", F.when(F.col("bundle_action") == "close_open", F.coalesce("first_tra", "first_open")).when(F.col("bundle_action") == "open_next", F.col("lo")))
    opening, closing = idx >= F.col("turn"), F.col("turn").isNull() | (idx < F.col("turn"))
    order = F.struct(F.when(~F.col("tra") & (F.col("icu") | F.col("orl")), 0).when(F.col("tra"), 1).otherwise(2).alias("p"), "idx")
    rows = rows.withColumns({
        "at": F.min_by(F.struct("type_id", "site"), if_cand(opening, order)).over(own), "open_us": F.min_by("t_us", if_cand(opening, idx)).over(own),
        "c_dis": F.max(if_cand(yes, (closing & F.col("dis")).cast("int"))).over(own), "c_dea": F.max(if_cand(yes, (closing & F.col("dea")).cast("int"))).over(own), "c_any": F.max(if_cand(yes, closing.cast("int"))).over(own),
    })
    is_open = F.col("turn").isNotNull()
    after = F.when(F.col("c_dea") == 1, _UNK).when(F.col("c_dis") == 1, _POST).otherwise(_UNK)
    rows = rows.withColumns({"m_type": F.when(is_open, F.coalesce("at.type_id", F.lit(_UNK))).otherwise(after), "m_site": F.when(is_open, F.col("at.site"))})
    # the candidate before a merged bundle's first one belongs to the merged bundle before
    was = F.last(F.when(F.col("cand"), F.struct("m_type", "m_site")), ignorenulls=True).over(_before())
    rows = rows.withColumn("was", was)
    same_site = (F.col("m_site") == F.col("was.m_site")) if site_change else F.col("was.m_site").isNotNull()
    preserved = is_open & (F.col("m_type") != _UNK) & (F.col("m_type") == F.col("was.m_type")) & F.col("m_site").isNotNull() & same_site
    rows = rows.withColumn("preserved", F.max(if_cand(idx == F.col("lo"), F.coalesce(preserved, F.lit(False)))).over(own))
    told = ("lo", "hi", "t_lo", "bundle_action", "turn", "open_us", "c_dis", "c_dea", "c_any", "m_type", "m_site", "preserved")
    rows = rows.withColumn("m", F.when(F.col("cand"), F.struct(*told)))
    return rows.drop(*told, "first_tra", "first_open", "closes", "at", "was", "cand", "bundle")


def merged_bundles(tokens: DataFrame, site_change: bool = True) -> DataFrame:
    """One row a merged bundle: its action, turn, the type and site it opens, what it
    closes, and whether it stays in the window before it (preserved)."""
    rows = _merged(tokens, site_change).where(F.col("idx") == F.col("m.lo"))
    return rows.select("subject_id", "merged", "m.lo", "m.hi", "m.t_lo", "m.bundle_action", "m.turn", "m.open_us", "m.c_dis", "m.c_dea", "m.c_any", F.col("m.m_type").alias("type"), F.col("m.m_site").alias("site"), "m.preserved")


def window_tokens(tokens: DataFrame, site_change: bool = True) -> DataFrame:
    """Tokens with window_ord (from 0), brk: whether a chunk must break there, opens: what
    begins here, and shut: what closes the window that ends here."""
    rows = _merged(tokens, site_change)
    w = _subject().orderBy("idx")
    m = lambda c: F.col(f"m.{c}")
    opener, ends = F.col("idx") == m("turn"), (F.col("idx") == m("hi")) & m("turn").isNull()
    fresh = opener & ~m("preserved")
    closer = F.lag(F.when(ends, m("m_type"))).over(w)
    opens = F.when(fresh, F.struct(m("m_type").alias("type"), m("m_site").alias("w_site"), m("bundle_action").alias("bundle_action"), m("open_us").alias("open_us")).cast(_OPENS)).when(closer.isNotNull(), F.struct(closer.alias("type"), F.lit(None).cast("string").alias("w_site"), F.lit(None).cast("string").alias("bundle_action"), F.lit(None).cast("long").alias("open_us")).cast(_OPENS))
    closing = F.struct(m("bundle_action").alias("action"), F.when(m("c_any") == 1, m("t_lo")).alias("us"), ((m("c_dis") == 1) | (m("c_dea") == 1)).alias("discharge")).cast(_CLOSES)
    # a bundle closes the window that ends with it, else the one that ends before its turn
    shut = F.coalesce(F.when(ends, closing), F.lead(F.when(fresh & (m("bundle_action") != "open_next"), closing)).over(w))
    rows = rows.withColumns({"opens": opens, "shut": shut, "kept": F.coalesce(opener & m("preserved"), F.lit(False))}).drop("m", "merged")
    rows = rows.withColumn("start", (F.col("idx") == 0) | F.col("opens").isNotNull())
    rows = rows.withColumn("window_ord", _counted(F.col("start")).over(_so_far()) - 1)
    return rows.withColumn("brk", F.col("kept") & ~F.col("start")).drop("kept", "start")


def _typed(opens: Column, first_type: Column, window_ord: Column, default_first: int) -> Column:
    opened = F.coalesce(opens["type"], F.lit(_UNK))
    kind = F.when(opened != _UNK, opened).otherwise(F.coalesce(first_type, F.lit(_UNK)))
    return F.when((window_ord == 0) & (kind == _UNK), default_first).otherwise(kind)


def windows(tokens: DataFrame, default_first: int = _UNK, site_change: bool = True) -> DataFrame:
    """One row a window: type, site, actions and times of opening and closing, sizes."""
    key = ["subject_id", "window_ord"]
    first = lambda c: F.min_by(c, "idx")
    out = window_tokens(tokens, site_change).groupBy(*key).agg(
        F.count("*").alias("n_tokens"), F.min("idx").alias("lo"), F.max("idx").alias("hi"), first("t_us").alias("start_us"), F.max_by("t_us", "idx").alias("end_us"), first("opens").alias("opens"), first(F.struct("type_id")).alias("first"),
        F.min_by("site", F.when(F.col("site").isNotNull(), F.col("idx"))).alias("any_site"), F.sum(F.col("brk").cast("int")).alias("n_breaks"), F.max_by("shut", "idx").alias("shut"),
    )
    kind = _typed(F.col("opens"), F.col("first.type_id"), F.col("window_ord"), default_first)
    return out.select(*key, kind.alias("type_id"), F.coalesce("opens.w_site", "any_site").alias("site"), F.col("opens.bundle_action").alias("opening_action"), F.col("opens.open_us").alias("opening_us"), F.col("shut.action").alias("closing_action"), F.col("shut.us").alias("closing_us"), F.coalesce("shut.discharge", F.lit(False)).alias("closing_discharge"), "n_tokens", "n_breaks", "lo", "hi", "start_us", "end_us")


def time_groups(rows: DataFrame, *within: str, most: int | Column | None = None) -> DataFrame:
    """Rows with grp: those of one time together, in slices of ``most`` at the most."""
    w = W.partitionBy("subject_id", *within).orderBy("idx")
    time = F.coalesce("raw_us", "t_us")
    new = F.coalesce(F.lag(time).over(w) != time, F.lit(True))
    rows = rows.withColumn("tie", F.sum(F.when(new, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    if most is None:
        return rows.withColumn("grp", F.col("tie") - 1).drop("tie")
    nth = F.row_number().over(W.partitionBy("subject_id", *within, "tie").orderBy("idx")) - 1
    rows = rows.withColumn("slice", F.floor(nth / most))
    first = F.coalesce((F.lag("tie").over(w) != F.col("tie")) | (F.lag("slice").over(w) != F.col("slice")), F.lit(True))
    return rows.withColumn("grp", F.sum(F.when(first, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)) - 1).drop("tie", "slice")


def _packed(groups: Column, most: int, target: int, tail: int) -> Column:
    """Sizes of chunks of groups(len, brk), packed greedily in order: a group joins while
    there is no break, the sum fits and the chunk is below its target; a short last chunk
    joins the one before it if that fits."""
    zero = F.struct(F.array().cast("array<struct<len:long,brk:boolean>>").alias("done"), F.lit(0).cast("long").alias("cur"), F.lit(False).alias("brk"))

    def add(acc, g):
        fits = ~g["brk"] & (acc["cur"] + g["len"] <= most) & (acc["cur"] < target)
        chunk = F.array(F.struct(acc["cur"].alias("len"), acc["brk"].alias("brk")))
        done = F.when(fits | (acc["cur"] == 0), acc["done"]).otherwise(F.concat(acc["done"], chunk))
        grow = fits | (acc["cur"] == 0)
        return F.struct(done.alias("done"), F.when(grow, acc["cur"] + g["len"]).otherwise(g["len"]).alias("cur"), F.when(grow, acc["brk"] | (g["brk"] & (acc["cur"] == 0))).otherwise(g["brk"]).alias("brk"))

    def finish(acc):
        merge = (F.size(acc["done"]) > 0) & (acc["cur"] < tail) & ~acc["brk"] & (F.try_element_at(acc["done"], F.lit(-1))["len"] + acc["cur"] <= most)
        joined = F.concat(F.slice(acc["done"], F.lit(1), F.greatest(F.size(acc["done"]) - 1, F.lit(0))), F.array(F.struct((F.try_element_at(acc["done"], F.lit(-1))["len"] + acc["cur"]).alias("len"), F.try_element_at(acc["done"], F.lit(-1))["brk"].alias("brk"))))
        return F.transform(F.when(merge, joined).otherwise(F.concat(acc["done"], F.array(F.struct(acc["cur"].alias("len"), acc["brk"].alias("brk"))))), lambda c: c["len"])

    return F.aggregate(groups, zero, add, finish)


def chunks(tokens: DataFrame, most: int = C.CHUNK_MAX, smallest: int = C.CHUNK_MIN, fraction: float = C.CHUNK_FRACTION, tail: int = C.CHUNK_TAIL, breaks: bool = True, target: int | None = None) -> DataFrame:
    """subject_id, window_ord, chunk_ord, len, from_pos: chunks of windows, packed from
    groups of equal times so that none holds more than ``most`` tokens. A transition inside
    a window that begins a group ends the chunk before it; without breaks it does not.
    A chunk is full at its target: what is given, else the fraction of ``most``, rounded."""
    rows = time_groups(window_tokens(tokens), "window_ord", most=most)
    groups = rows.groupBy("subject_id", "window_ord", "grp").agg(F.count("*").alias("len"), F.min_by("brk", "idx").alias("brk"))
    packs = groups.groupBy("subject_id", "window_ord").agg(F.sort_array(F.collect_list(F.struct("grp", "len", (F.col("brk") & F.lit(breaks)).alias("brk")))).alias("g"))
    target = max(smallest, round(most * fraction)) if target is None else target
    sized = packs.select("subject_id", "window_ord", _packed(F.transform("g", lambda x: F.struct(x["len"].alias("len"), x["brk"].alias("brk"))), most, target, tail).alias("sizes"))
    out = sized.select("subject_id", "window_ord", F.posexplode("sizes").alias("chunk_ord", "len"))
    before = F.sum("len").over(W.partitionBy("subject_id", "window_ord").orderBy("chunk_ord").rowsBetween(W.unboundedPreceding, -1))
    return out.withColumn("from_pos", F.coalesce(before, F.lit(0)))


def _first_chunks(groups: Column, most: Column, target: Column, tail: int, cap: int) -> Column:
    """sizes of the first ``cap`` chunks that ``_packed`` makes, and n, how many it makes: no
    more is kept of the others than their number."""
    zero = F.struct(F.array().cast("array<bigint>").alias("done"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("prev"), F.lit(0).cast("long").alias("cur"), F.lit(False).alias("brk"))
    put = lambda acc, x: F.when(acc["n"] < cap, F.concat(acc["done"], F.array(x))).otherwise(acc["done"])

    def add(acc, g):
        grow = (acc["cur"] == 0) | (~g["brk"] & (acc["cur"] + g["len"] <= most) & (acc["cur"] < target))
        begins = (acc["cur"] == 0) | ~grow
        return F.struct(
            F.when(grow, acc["done"]).otherwise(put(acc, acc["cur"])).alias("done"), F.when(grow, acc["n"]).otherwise(acc["n"] + 1).alias("n"), F.when(grow, acc["prev"]).otherwise(acc["cur"]).alias("prev"),
            F.when(grow, acc["cur"] + g["len"]).otherwise(g["len"]).alias("cur"), F.when(begins, g["brk"]).otherwise(acc["brk"]).alias("brk"),
        )

    def finish(acc):
        joins = (acc["n"] > 0) & (acc["cur"] < tail) & ~acc["brk"] & (acc["prev"] + acc["cur"] <= most)
        longer = F.when(acc["n"] <= cap, F.concat(F.slice(acc["done"], F.lit(1), F.greatest(F.size(acc["done"]) - 1, F.lit(0))), F.array(acc["prev"] + acc["cur"]))).otherwise(acc["done"])
        return F.struct(F.when(joins, longer).otherwise(put(acc, acc["cur"])).alias("sizes"), F.when(joins, acc["n"]).otherwise(acc["n"] + 1).alias("n"))

    return F.aggregate(groups, zero, add, finish)


def chunked_windows(tokens: DataFrame, most: int | Column, cap: int = C.CHUNK_CAP, columns: tuple[str, ...] = ("idx", "t_us"), smallest: int = C.CHUNK_MIN, fraction: float = C.CHUNK_FRACTION, tail: int = C.CHUNK_TAIL, default_first: int = _UNK, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a window: what carry names of its first token, type_id, start_us, end_us, n_tokens, n_structural, sizes (of its
    first ``cap`` chunks), n_chunks (of all) and x, the columns of the tokens of these chunks,
    in order. most may follow from the subject. All on the timeline's own partitioning: of a
    long window, x holds cap * most tokens at the most."""
    key = ["subject_id", "window_ord"]
    limit = most if isinstance(most, Column) else F.lit(most)
    rows = time_groups(window_tokens(tokens), "window_ord", most=limit)
    own = W.partitionBy(*key).orderBy("idx")
    rows = rows.withColumns({"nth": F.row_number().over(own) - 1, "_most": limit.cast("long"), "new": F.coalesce(F.lag("grp").over(own) != F.col("grp"), F.lit(True))})
    held = W.partitionBy(*key, "grp")
    rows = rows.withColumn("g", F.when(F.col("new"), F.struct("grp", F.count("*").over(held).alias("len"), "brk")))
    first = lambda c: F.min_by(c, "idx")
    kept = F.when(F.col("nth") < cap * F.col("_most"), F.struct(*columns))
    out = rows.groupBy(*key).agg(
        F.count("*").alias("n_tokens"), F.count_if(F.col("category") == "STRUCTURAL").alias("n_structural"), first("t_us").alias("start_us"), F.max_by("t_us", "idx").alias("end_us"), first("opens").alias("opens"), first(F.struct("type_id")).alias("first"),
        *[first(c).alias(c) for c in carry], F.first("_most").alias("most"), F.sort_array(F.collect_list("g")).alias("g"), F.sort_array(F.collect_list(kept)).alias("x"),
    )
    target = F.greatest(F.lit(smallest), F.least(F.col("most"), F.greatest(F.lit(1), F.bround(F.col("most") * F.lit(fraction))).cast("long")))
    out = out.withColumn("p", _first_chunks(F.transform("g", lambda x: F.struct(x["len"].alias("len"), x["brk"].alias("brk"))), F.col("most"), target, tail, cap))
    kind = _typed(F.col("opens"), F.col("first.type_id"), F.col("window_ord"), default_first)
    return out.select(*key, *carry, kind.alias("type_id"), "start_us", "end_us", "n_tokens", "n_structural", "p.sizes", F.col("p.n").alias("n_chunks"), "x")


def rebalanced(tokens: DataFrame, **sizes) -> DataFrame:
    """Dense windows cut into windows of their own: subject_id, window_ord (anew), parent
    (the window it was part of), len, from_pos."""
    c = chunks(tokens, breaks=False, **sizes)
    order = W.partitionBy("subject_id").orderBy("window_ord", "chunk_ord")
    return c.select("subject_id", (F.row_number().over(order).cast("long") - 1).alias("new"), F.col("window_ord").alias("parent"), "len", "from_pos").withColumnRenamed("new", "window_ord")


def _followed(tokens: DataFrame, cutoff_h: float) -> DataFrame:
    """window_tokens with part and trajectory_ord.

    A discharge sets a cut-off for the windows after it, up to the next discharge; the
    first of them that begins, or (after a discharge) ends, beyond it uses it up: it starts
    a new trajectory, or is split there."""
    own = W.partitionBy("subject_id", "window_ord")
    rows = window_tokens(tokens)
    first = lambda c: F.min_by(c, "idx").over(own)
    rows = rows.withColumns({"w_lo": F.min("idx").over(own), "w_start": first("t_us"), "w_end": F.max_by("t_us", "idx").over(own), "w_opens": first("opens"), "w_first": first(F.struct("type_id")), "w_shut": F.max_by("shut", "idx").over(own)})
    head = F.col("idx") == F.col("w_lo")
    post = _typed(F.col("w_opens"), F.col("w_first.type_id"), F.col("window_ord"), _UNK) == _POST
    rows = rows.withColumn("cut", F.when(head & F.col("w_shut.discharge"), F.col("w_shut.us") + int(cutoff_h * HOUR_US)))
    rows = rows.withColumns({"limit": F.last("cut", ignorenulls=True).over(_before()), "turns": F.coalesce(_counted(F.col("cut").isNotNull()).over(_before()), F.lit(0))})
    beyond = (F.col("w_start") > F.col("limit")) | (post & (F.col("w_end") > F.col("limit")))
    rows = rows.withColumn("beyond", head & F.coalesce(beyond, F.lit(False)))
    # rows after a window's first see its own cut-off: they are in the next span already
    spent = F.coalesce(_counted(F.col("beyond")).over(W.partitionBy("subject_id", "turns").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) > 0
    rows = rows.withColumn("uses", F.col("beyond") & ~spent)
    over = F.col("uses") & (F.col("w_start") > F.col("limit"))
    inside = F.col("uses") & ~(F.col("w_start") > F.col("limit"))
    rows = rows.withColumns({"over": over, "inside": inside})
    before = F.coalesce(_counted(F.col("inside")).over(_before()), F.lit(0))
    rows = rows.withColumn("begun", _counted(F.col("over")).over(_so_far()) + before)
    rows = rows.withColumns({"begun": F.max(F.when(head, F.col("begun"))).over(own), "split_us": F.max(F.when(F.col("inside"), F.col("limit"))).over(own)})
    rows = rows.withColumn("part", F.when(F.col("t_us") > F.col("split_us"), 1).otherwise(0))
    rows = rows.withColumn("trajectory_ord", (F.col("begun") + F.col("part")).cast("int"))
    return rows.drop("w_lo", "w_start", "w_end", "w_opens", "w_first", "w_shut", "cut", "limit", "turns", "beyond", "uses", "over", "inside", "begun", "split_us")


def trajectories(tokens: DataFrame, cutoff_h: float = C.CUTOFF_H, mode: str = "admission_chain") -> DataFrame:
    """Tokens' windows grouped into admission chains: subject_id, window_ord, part,
    trajectory_ord. A discharge sets a cut-off; what begins after it starts a new
    trajectory, and a post-discharge window that crosses it is split there (part 1). In
    the mode full_subject a history is one trajectory."""
    if mode == "full_subject":
        rows = window_tokens(tokens).withColumns({"part": F.lit(0), "trajectory_ord": F.lit(0)})
    else:
        rows = _followed(tokens, cutoff_h)
    return rows.groupBy("subject_id", "window_ord", "part").agg(F.min("trajectory_ord").alias("trajectory_ord"), F.count("*").alias("n_tokens"), F.min("t_us").alias("start_us"), F.min("idx").alias("lo"))


def trajectory_clock(tokens: DataFrame, cutoff_h: float = C.CUTOFF_H) -> DataFrame:
    """Tokens on their trajectory's own clock, its first token's gap at 0."""
    own = W.partitionBy("subject_id", "trajectory_ord")
    rows = _followed(tokens, cutoff_h).withColumns({"begin": F.min("t_us").over(own), "head": F.min("idx").over(own)})
    return rows.select("subject_id", "trajectory_ord", "idx", F.greatest(F.col("t_us") - F.col("begin"), F.lit(0)).alias("t_us"), F.when(F.col("idx") == F.col("head"), 0).otherwise(F.col("dt_us")).alias("dt_us"))
