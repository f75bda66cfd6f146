"""Queries on timelines with token ids and what a model reads of them, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..operators import audit, collate, decode, encoding, ids, policies, quantise, timeline, trajectories, vocab
from ..sources import adapters as A
from ..sources import scratch
from ..sources import shards as store
from ..streaming import compile as increments
from . import oracle as O
from . import spelling as S
from .further import FILTERED
from .queries import CASCADE, CODE2ID, NUMERIC, SPECIALS, SPLIT, STATIC, STATS, TRAJECTORIES, query, recursive, specials, tokens, with_static

AT = C.FAMILY_OFFSETS
LEVELS, SIZE = 2, 256
BOOKS = quantise.scalar_books(LEVELS, SIZE, 7)


def encoders(spark, d, **more) -> tuple[DataFrame, DataFrame, encoding.Encoders]:
    """Events, their dictionary (kept) and the encoders over the shared test tables."""
    m = A.meds(spark, d)
    ev = timeline.classified(m)
    codes = scratch.kept(vocab.code_counts(ev), "codes")
    resolved = vocab.resolve(codes, scratch.kept(vocab.sample_vocab(codes), "vocab"), vocab.sample_parents(codes), vocab.sample_crosswalk(spark), vocab.sample_residual(spark), **{k: v for k, v in more.items() if k == "drop_unknowns"})
    measured = scratch.kept(audit.measurement_ids(ev, 5), "measured")
    numbers = scratch.kept(measured.drop("n").join(audit.variable_stats(ev, measured).drop("n"), "var_id"), "numbers")
    enc = encoding.Encoders(numbers, scratch.kept(encoding.structural_vocab(ev), "structural"), resolved, quantise.scalar_codes(BOOKS), LEVELS, SIZE)._replace(**{k: v for k, v in more.items() if k != "drop_unknowns"})
    table = scratch.kept(encoding.dictionary(m, enc), "dictionary")
    return A.meds(spark, d, deal=True, first=lambda rows: encoding.valued(rows, table, enc)), table, enc


def encoded(spark, d, **more) -> DataFrame:
    return encoding.tokens(*encoders(spark, d, **more))


def _books() -> str:
    return ", ".join("[" + ", ".join(f"{x!r}::double" for x in b[:, 0].tolist()) + f"] as b{i}" for i, b in enumerate(BOOKS))


def _nearest(book: str, x: str) -> str:
    return S.let(f"list_transform({book}, lambda y: abs(y - {x}))", lambda a: f"list_position({a}, list_min({a}))") + " - 1"


_MARKS = O.mapped("mark", {m: str(i) for i, m in enumerate(encoding.MARKS, 1)})
_UNK = "case category when 'DIAGNOSIS' then 1000000 when 'PROCEDURE' then 1200000 else 1400000 end"
_LANE = AT["observation_value"] - AT["observation_code"] - 1
_RESERVED = O.mapped("upper(vs)", {k: str(v) for k, v in C.OBSERVATION_VALUES.items()})
_HOOK = f"coalesce(label in ({O.quoted(C.BOUNDARY_LABELS)}), action in ({O.quoted(C.ACTIVE)}), false)"
#: td: tokens with ids, in the form of the table tk of ``oracle``, and gid and level.
ENCODED = f"""{CODE2ID}, {STATS}, {CASCADE}, bo as (select {_books()}),
 sv as (select surface, row_number() over (order by surface) as raw_id from (select distinct case when label is not null then code else p end as surface from ev where label is not null or category = 'STRUCTURAL')),
 e1 as (select ev.*, case when label is not null then code when category = 'STRUCTURAL' then p end as ss, var_id, case when category = 'MEASUREMENT' and {NUMERIC} and var_id is not null then least(greatest((numeric_value - mean) / std, -8), 8) end as z,
  {O.OBS} as cs, {O.OBS_VALUE} as vs, {O.MARK} as mark, case when category = 'MEDICATION' and {NUMERIC} then numeric_value end as mv from ev left join c2i using (code) left join (select var_id, mean, std from vs) vs using (var_id)),
 ob as materialized (select cs, vs, {S.crc('cs')} % {_LANE} + 1 + {AT['observation_code']} as cg, coalesce(({_RESERVED})::bigint, {S.crc("'OBS_VAL::' || vs")} % {C.OBSERVATION_VALUE_LANE} + 1) + {AT['observation_value']} as vg from (select distinct cs, vs from e1 where category = 'MEASUREMENT' and z is null and cs is not null), crc_step),
 zz as materialized (select subject_id, pos, sign(z) * ln(1 + abs(z)) as x from e1 where z is not null), z0 as (select zz.*, b0, b1, {_nearest('b0', 'x')} as k0 from zz, bo), zc as materialized (select subject_id, pos, k0, {_nearest('b1', '(x - b0[k0 + 1])')} as k1 from z0),
 td0 as (select e1.* exclude (z, var_id, cs, vs, mark, mv, ss), 0 as o, 'STRUCT' as kind, ss as surface, cast(null as double) as tv, sv.raw_id + {AT['structural']} as gid, cast(null as int) as level from e1 join sv on sv.surface = ss
  union all select e1.* exclude (z, var_id, cs, vs, mark, mv, ss), 1, 'MEAS', code, z, var_id + {AT['measurement_code']}, null from e1 where z is not null
  union all select e1.* exclude (z, var_id, cs, vs, mark, mv, ss), 2, 'VALUE', code, null, k0 + {AT['measurement_value']}, 0 from e1 join zc using (subject_id, pos)
  union all select e1.* exclude (z, var_id, cs, vs, mark, mv, ss), 3, 'VALUE', code, null, k1 + {AT['measurement_value'] + SIZE}, 1 from e1 join zc using (subject_id, pos)
  union all select e1.* exclude (z, var_id, cs, vs, mark, mv, ss), 4, 'OBS_CODE', e1.cs, null, cg, null from e1 join ob on ob.cs = e1.cs and ob.vs = e1.vs where category = 'MEASUREMENT' and z is null
  union all select e1.* exclude (z, var_id, cs, vs, mark, mv, ss), 5, 'OBS_VALUE', e1.vs, null, vg, null from e1 join ob on ob.cs = e1.cs and ob.vs = e1.vs where category = 'MEASUREMENT' and z is null
  union all select e1.* exclude (z, var_id, cs, vs, mark, mv, ss), 6, 'CODE', base, mv, rv.gid, null from e1 join rv using (category, code) join (select category, code, base from cc) using (category, code) where category <> 'STRUCTURAL'
  union all select e1.* exclude (z, var_id, cs, vs, mark, mv, ss), 7, 'MARK', mark, mv, {_UNK}, null from e1 where category in ('DIAGNOSIS','PROCEDURE','MEDICATION') and mark is not null),
 em as (select subject_id, pos, max(t_us) over (partition by subject_id order by pos rows between unbounded preceding and 1 preceding) as last_us from (select distinct subject_id, pos, t_us from td0)),
 st as (select subject_id, min(t_us) as start_us from m group by 1),
 tk as materialized (select a.subject_id, a.pos, row_number() over (partition by a.subject_id, a.pos order by o) - 1 as tok_ord, row_number() over (partition by a.subject_id order by a.pos, o) - 1 as idx,
  kind, surface, tv as value, case when kind = 'STRUCT' then 'STRUCTURAL' else category end as category, a.t_us as raw_us, a.t_us - start_us as t_us,
  case when o = min(o) over (partition by a.subject_id, a.pos) then coalesce(a.t_us - last_us, 0) else 0 end as dt_us, kind = 'STRUCT' and {_HOOK} as hook,
  case when kind = 'STRUCT' then label end as label, case when kind = 'STRUCT' then action end as action, case when kind = 'STRUCT' then type_id end as type_id, case when kind = 'STRUCT' then site end as site,
  kind = 'STRUCT' and adm as adm, kind = 'STRUCT' and tra as tra, kind = 'STRUCT' and dis as dis, kind = 'STRUCT' and dea as dea, kind = 'STRUCT' and icu as icu, kind = 'STRUCT' and orl as orl, gid, level
 from td0 a join em on a.subject_id = em.subject_id and a.pos = em.pos join st on a.subject_id = st.subject_id)"""


def encoded_sql(select: str, further: str = "") -> str:
    """select over tk, the timeline with ids; further: tables that follow it, as in oracle."""
    return O.coded("").rstrip() + ", " + ENCODED + further + " " + select


@query(encoded_sql("select subject_id, pos, idx, kind, category, gid, level, round(value, 6) as value, t_us, dt_us, hook from tk"))
def timeline_ids(spark, d):
    return encoded(spark, d).select("subject_id", "pos", "idx", "kind", "category", "gid", "level", F.round("value", 6).alias("value"), "t_us", "dt_us", "hook")


@query(encoded_sql(f"select case when gid >= {AT['observation_value']} then 'observation_value' when gid >= {AT['observation_code']} then 'observation_code' when gid >= {AT['structural']} then 'structural' when gid >= {AT['measurement_value']} then 'measurement_value' when gid >= {AT['measurement_code']} then 'measurement_code' when gid >= {AT['medication']} then 'medication_or_med_attr' when gid >= {AT['procedure']} then 'procedure' when gid >= {AT['diagnosis']} then 'diagnosis' else 'special_or_window' end as family, kind, count(*) as n, count(distinct gid) as ids, min(gid) as lowest, max(gid) as highest from tk group by 1, 2"))
def timeline_id_families(spark, d):
    t = encoded(spark, d)
    return t.groupBy(ids.family(F.col("gid")).alias("family"), "kind").agg(F.count("*").alias("n"), F.count_distinct("gid").alias("ids"), F.min("gid").alias("lowest"), F.max("gid").alias("highest"))


# --- sequences ---

LENGTH = 128
CHUNKED = f"""{O.BUNDLES}{O.MERGED}{O.WINDOWS}, {SPECIALS}, ns as (select subject_id, count(*) as k from sp group by 1),
 wk as (select wt.*, greatest(1, {LENGTH} - 2 - coalesce(k, 0)) as most from wt left join ns using (subject_id)),
 g0 as (select *, sum(case when same then 0 else 1 end) over (partition by subject_id, window_ord order by idx) as tie from (select subject_id, window_ord, idx, most, kept and not starts as brk, coalesce(raw_us, t_us) = lag(coalesce(raw_us, t_us)) over (partition by subject_id, window_ord order by idx) is true as same from wk)),
 g1 as (select *, (row_number() over (partition by subject_id, window_ord, tie order by idx) - 1) // most as slice from g0),
 g2 as (select subject_id, window_ord, tie, slice, count(*) as len, arg_min(brk, idx) as brk, any_value(most) as most from g1 group by 1, 2, 3, 4),
 g as materialized (select subject_id, window_ord, row_number() over (partition by subject_id, window_ord order by tie, slice) as grp, len, brk, most, greatest({C.CHUNK_MIN}, least(most, greatest(1, round_even(most * {C.CHUNK_FRACTION}::double, 0)))) as target from g2),
 sq(subject_id, window_ord, grp, len, cur, chunk, brk) as (select subject_id, window_ord, grp, len, len, 0, brk from g where grp = 1
  union all select g.subject_id, g.window_ord, g.grp, g.len, case when not g.brk and cur + g.len <= most and cur < target then cur + g.len else g.len end, case when not g.brk and cur + g.len <= most and cur < target then chunk else chunk + 1 end, g.brk
  from sq join g on g.subject_id = sq.subject_id and g.window_ord = sq.window_ord and g.grp = sq.grp + 1),
 ch0 as (select subject_id, window_ord, chunk, sum(sq.len) as len, arg_min(sq.brk, grp) as brk, any_value(most) as most from sq join g using (subject_id, window_ord, grp) group by 1, 2, 3),
 ch1 as (select *, lag(len) over w as before, lead(chunk) over w is null as ends from ch0 window w as (partition by subject_id, window_ord order by chunk)),
 ch2 as (select subject_id, window_ord, case when ends and before is not null and len < {C.CHUNK_TAIL} and not brk and before + len <= most then chunk - 1 else chunk end as chunk_ord, len from ch1),
 ck as (select *, (sum(len) over (partition by subject_id, window_ord order by chunk_ord) - len)::bigint as from_pos from (select subject_id, window_ord, chunk_ord, sum(len)::bigint as len from ch2 group by 1, 2, 3))"""
_SUFFIX = f"case when chunk_ord < top then {C.CONTINUE_TOKEN} when {{next}} and next_type is not null then {C.TYPE_TOKEN} + next_type else {C.END_TOKEN} end"
_SEQUENCES = """, kc as (select *, max(chunk_ord) over (partition by subject_id, window_ord) as top from ck where window_ord < {most} and chunk_ord < {cap}),
 wn as (select *, lead(type_id) over w as next_type, lead(start_us) over w as next_us from ws where window_ord < {most} window w as (partition by subject_id order by window_ord)),
 pt as (select kc.subject_id, kc.window_ord, chunk_ord, top, wt.* exclude (subject_id, window_ord), min(t_us) over c as begin, max(nth) over c as high from kc join (select *, row_number() over (partition by subject_id, window_ord order by idx) - 1 as nth from wt) wt on wt.subject_id = kc.subject_id and wt.window_ord = kc.window_ord and nth >= from_pos and nth < from_pos + len window c as (partition by kc.subject_id, kc.window_ord, chunk_ord)),
 st0 as (select distinct subject_id, window_ord, chunk_ord, top, begin from pt), en as (select subject_id, window_ord, chunk_ord, t_us as end_us from pt where nth = high),
 pl as (select c.*, 0 as part, ord as place, token_id as id, 0 as t, case when value is null then 0 else value end as v, (value is not null)::int as m, 0 as cat from st0 c join sp using (subject_id)
  union all select c.*, 1, 0, {type_token} + type_id, 0, 0, 0, 0 from st0 c join wn using (subject_id, window_ord)
  union all select subject_id, window_ord, chunk_ord, top, begin, 2, nth, gid, greatest(t_us - begin, 0), case when category = 'MEDICATION' and value is not null then value else 0 end, (category = 'MEDICATION' and value is not null)::int, list_position([{categories}], category) - 1 from pt
  union all select c.*, 3, 0, {suffix}, greatest(case when chunk_ord = top and {next} and next_type is not null then next_us else en.end_us end - begin, 0), 0, 0, 0 from st0 c join en using (subject_id, window_ord, chunk_ord) join wn using (subject_id, window_ord)),
 sr as (select subject_id, window_ord, chunk_ord, count(*) as n, list(id::bigint order by part, place) as i, list(t::bigint order by part, place) as t, list(round(v, 4)::double order by part, place) as v, list(m order by part, place) as m, list(cat order by part, place) as k, any_value(begin) as begin, any_value(top) as top from pl group by 1, 2, 3)
 select subject_id, window_ord, chunk_ord::bigint as chunk_ord, n, array_to_string(i, ',') as ids, array_to_string(t, ',') as times_us, round(list_sum(v), 3) as value_sum, array_to_string(m, ',') as value_mask, array_to_string(k, ',') as types, type_id as window_type, (begin - start_us)::bigint as offset_us, chunk_ord = top as "last", n_tokens as window_tokens from sr join ws using (subject_id, window_ord)"""


def _sequences(next_type: bool, most: int, cap: int) -> str:
    suffix = _SUFFIX.format(next=str(next_type).lower())
    return recursive(encoded_sql(_SEQUENCES.format(most=most, cap=cap, suffix=suffix, next=str(next_type).lower(), type_token=C.TYPE_TOKEN, categories=O.quoted(C.CATEGORIES)), CHUNKED))


def collated(spark, d) -> DataFrame:
    own = scratch.kept(collate.special_arrays(specials(spark, d)), "specials")
    return collate.collated(encoded(spark, d), own, LENGTH)


def _shown(rows: DataFrame) -> DataFrame:
    n = F.aggregate("mask", F.lit(0), lambda a, x: a + x)
    text = lambda c: F.array_join(F.slice(c, F.lit(1), F.col("n")), ",")
    us = lambda h: F.round(h * 3.6e9).cast("long")
    rows = rows.withColumn("n", n)
    return rows.select("subject_id", "window_ord", "chunk_ord", F.col("n").cast("long").alias("n"), text("ids").alias("ids"), F.array_join(F.transform(F.slice("times", F.lit(1), F.col("n")), us), ",").alias("times_us"), F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + F.round(x, 4)), 3).alias("value_sum"), text("value_mask").alias("value_mask"), text("types").alias("types"), "window_type", us(F.col("offset_h")).alias("offset_us"), "last", "window_tokens")


@query(_sequences(False, C.WINDOW_CAP, C.CHUNK_CAP))
def chunk_sequences(spark, d):
    return _shown(collate.sequences(collated(spark, d), LENGTH))


@query(_sequences(True, 20, C.CHUNK_CAP))
def chunk_sequences_next_type(spark, d):
    return _shown(collate.sequences(collated(spark, d), LENGTH, 20, "next_type"))


@query(recursive(encoded_sql(""", wc as (select subject_id, window_ord, count(*) as chunks, count(*) filter (where chunk_ord < 1) as kept_chunks, sum(len) filter (where chunk_ord < 1) as kept_tokens from ck group by 1, 2),
 wa as (select subject_id, window_ord, count(*) as n, count(*) filter (where category = 'STRUCTURAL') as s, count(*) filter (where category = 'STRUCTURAL' and nth < kept_tokens) as ks from (select *, row_number() over (partition by subject_id, window_ord order by idx) - 1 as nth from wt) join wc using (subject_id, window_ord) group by 1, 2),
 su as (select subject_id, count(*) as windows, count(*) filter (where window_ord < 12) as kept, coalesce(sum(n) filter (where window_ord >= 12), 0) as tokens, coalesce(sum(s) filter (where window_ord >= 12), 0) as structural, sum(chunks - kept_chunks) filter (where window_ord < 12) as chunks, sum(n - kept_tokens) filter (where window_ord < 12) as chunk_tokens, sum(s - ks) filter (where window_ord < 12) as chunk_structural from wa join wc using (subject_id, window_ord) group by 1)
 select count(*) as subjects, count(*) filter (where kept < windows or chunks > 0 or tokens > 0 or chunk_tokens > 0) as subjects_with_overflow, sum(windows)::bigint as windows_total, sum(kept)::bigint as windows_kept, sum(tokens)::bigint as tokens_dropped, sum(structural)::bigint as structural_dropped, sum(chunks)::bigint as chunks_dropped, sum(chunk_tokens)::bigint as chunk_tokens_dropped, sum(chunk_structural)::bigint as chunk_structural_dropped, (sum(windows) - sum(kept))::bigint as windows_dropped,
  round(count(*) filter (where kept < windows or chunks > 0 or tokens > 0 or chunk_tokens > 0) / count(*), 6) as subjects_with_overflow_share, round((sum(windows) - sum(kept)) / sum(windows), 6) as windows_dropped_share from su""", CHUNKED)))
def sequence_overflow(spark, d):
    own = scratch.kept(collate.special_arrays(specials(spark, d)), "specials")
    w = collate.overflow_report(collate.collated(encoded(spark, d), own, LENGTH, cap=1), 12)
    return w.withColumns({c: F.round(c, 6) for c in w.columns if c.endswith("_share")})


# --- decoding ---


def decoded(spark, d) -> DataFrame:
    m, table, enc = encoders(spark, d)
    codes = scratch.kept(vocab.code_counts(timeline.classified(A.meds(spark, d))), "codes")
    known = decode.names(vocab.sample_vocab(codes), enc.structural, enc.measurements, vocab.sample_residual(spark))
    return decode.items(encoding.tokens(m, table, enc), known, LEVELS, SIZE)


_ITEM = f"""im as (select *, sum((kind not in ('VALUE', 'OBS_VALUE'))::int) over (partition by subject_id order by idx) - 1 as item from tk),
 nm as (select raw_id + case category when 'DIAGNOSIS' then {AT['diagnosis']} when 'PROCEDURE' then {AT['procedure']} else {AT['medication']} end as gid, base as name from vo union all select raw_id + {AT['structural']}, surface from sv union all select var_id + {AT['measurement_code']}, code from c2i union all select 1 + {AT['medication_residual']}, 'MEDICATION//ACETAMINOPHEN'),
 dc as (select subject_id, item, arg_min(kind, idx) as kind, arg_min(category, idx) as category, arg_min(gid, idx) as gid, arg_min(surface, idx) as surface, arg_min(label, idx) as own, arg_min(value, idx) as value, min(t_us) as t_us, arg_min(dt_us, idx) as dt_us, arg_min(hook, idx) as hook, arg_min(action, idx) as action, arg_min(type_id, idx) as type_id, min(idx) as lo, max(idx) as hi, arg_max(gid, idx) as last, list(gid - {AT['measurement_value']} - level * {SIZE} order by idx) filter (where kind = 'VALUE') as codes from im group by 1, 2)"""


@query(encoded_sql("select subject_id, item, case kind when 'MEAS' then 'measurement_bundle' when 'OBS_CODE' then 'observation_bundle' else 'token' end as item_kind, category, dc.gid, case when kind = 'OBS_CODE' then null when kind = 'MARK' and category = 'MEDICATION' then 'MED_MARKER::' || surface when kind = 'STRUCT' then coalesce(own, name) else name end as label, case when kind = 'OBS_CODE' then last end as value_gid, array_to_string(codes, ',') as codes, round(value, 6) as value, t_us, dt_us, hook, action, lo, hi from dc left join nm using (gid)", ", " + _ITEM))
def decode_items(spark, d):
    out = decoded(spark, d)
    return out.drop("type_id").withColumns({"codes": F.array_join("codes", ","), "value": F.round("value", 6)})


#: Sizes of the blocks; none wraps around.
BLOCK_SIZES = {"special": 100, "structural": 1_000, "measurement_code": 10_000, "measurement_value": LEVELS * SIZE, "observation_code": 19_999, "observation_value": 80_001, "diagnosis": 100_000, "diagnosis_residual": 39_999, "procedure": 100_000, "procedure_residual": 39_999, "medication": 100_000, "medication_residual": 39_999}
_BLOCKS = "bk as (select * from (values " + ", ".join(f"('{n}', {C.LANES.index(C.BLOCK_LANES[n])}, {i}, {AT[n]}, {BLOCK_SIZES[n]})" for i, n in enumerate(C.BLOCK_LANES)) + ") t(name, lane_ord, ord, off, size))"
_DENSE = f""", {_BLOCKS}, og as (select distinct gid from tk), sn as (select name, gid from og join bk on gid between off and off + size - 1 where name <> 'special'), kept as (select * from sn union all select name, off from bk where name <> 'special' and name not in (select name from sn) union all select 'special', unnest(range(100))),
 dn as (select name, gid, row_number() over (order by lane_ord, ord, gid) - 1 as dense_id from kept join bk using (name))"""


@query(encoded_sql("select gid, name as block, dense_id, gid as back, true as exact, n from dn join (select gid, count(*) as n from tk group by 1) using (gid)", _DENSE))
def dense_round_trip(spark, d):
    """Ids of the timeline to a model's dense ids and back."""
    seen = scratch.kept(encoded(spark, d).groupBy("gid").agg(F.count("*").alias("n")), "gids")
    blocks, table = ids.compacted(ids.layout(spark, BLOCK_SIZES), seen, ("special",))
    dense = ids.remapped(seen, blocks, table).withColumnRenamed("gid", "own").drop("block")
    return decode.sparse(dense, blocks, table).select(F.col("own").alias("gid"), "block", "dense_id", F.col("gid").alias("back"), "exact", "n")


# --- boundary policies over decoded items ---

_WHY = S.some("""[case when policy in ('current', 'current_plus_gap') and hook then 'window_hook' end, case when policy in ('all_structural', 'structural_or_gap') and category = 'STRUCTURAL' then 'structural_any' end,
 case when (starts_with(policy, 'transition_like') or starts_with(policy, 'marker_or_transition')) and moves then 'transition_like' end, case when starts_with(policy, 'marker_or_transition') and marks then 'marker_like' end,
 case when starts_with(policy, 'custom_contains') and contains(text, 'ICU') then 'contains:ICU' end, case when (policy = 'gap_only' or ends_with(policy, 'gap')) and item > 0 and dt_us >= 6 * 3600000000 then 'gap>=6h' end]""")
_JUDGED = f""", {_ITEM}, it as (select subject_id, item, category, hook, action, type_id, t_us, dt_us, lo, hi, coalesce(case when kind = 'OBS_CODE' then 'MEASUREMENT::None' when kind = 'MARK' and category = 'MEDICATION' then 'MED_MARKER::' || surface when kind = 'STRUCT' then coalesce(own, name) else name end, case when kind = 'MEAS' then 'VAR::' || (dc.gid - {AT['measurement_code']}) else category || '::' || dc.gid end) as label from dc left join nm using (gid)),
 ix as (select *, upper(label || ' | ' || case when hook then 'WINDOW_BOUNDARY' else '' end || ' | ' || category) as text, category = 'STRUCTURAL' and coalesce(action in ({O.quoted(C.ACTIVE)}), false) as moves from it),
 iw as (select *, {O.contains('text', C.MARKER_PARTS)} as marks from ix), ir as materialized (select iw.*, policy, {_WHY} as why from iw, (select unnest([{O.quoted(audit.POLICIES)}]) as policy)),
 ic as (select *, lag(item) over w as pi, lag(t_us) over w as pt from ir where len(why) > 0 window w as (partition by subject_id, policy order by item)),
 ib as (select *, sum((pi is null or item - pi > {C.BUNDLE_GAP_IDX} or abs(t_us - pt) > {int(C.BUNDLE_GAP_H * O.H)})::int) over (partition by subject_id, policy order by item) as bundle from ic),
 bs as (select subject_id, policy, bundle, min(item) as lo_item, max(item) as hi_item, {S.unique('flatten(list(why order by item))')} as reasons from ib group by 1, 2, 3),
 bm as (select bs.*, ir.item, ir.label, ir.action as act, coalesce(bool_or(ir.action = 'open_next') over (partition by bs.subject_id, bs.policy, bundle order by ir.item rows between unbounded preceding and 1 preceding), false) as seen from bs join ir on ir.subject_id = bs.subject_id and ir.policy = bs.policy and ir.item between lo_item and hi_item),
 ba as (select subject_id, policy, bundle, case when bool_or(act = 'close_open') or (bool_or(act = 'open_next') and bool_or(act = 'close_current')) then 'close_open' when bool_or(act = 'open_next') then 'open_next' when bool_or(act = 'close_current') then 'close_current' else 'open_next' end as action from bm group by 1, 2, 3),
 b1s as (select bm.*, action, case when action <> 'close_open' then action = 'open_next' when act = 'close_current' then false when act = 'open_next' then true else seen end as opens from bm join ba using (subject_id, policy, bundle)),
 b2s as (select *, count(*) filter (where opens) over w as n_open, count(*) over w as n from b1s window w as (partition by subject_id, policy, bundle)),
 b3s as (select * replace (case when action <> 'close_open' then opens when n_open = n and n > 1 and item = lo_item then false when n_open = 0 and item = hi_item then true else opens end as opens) from b2s),
 bo_ as (select subject_id, policy, bundle, any_value(lo_item) as lo_item, any_value(hi_item) as hi_item, any_value(action) as action, coalesce(arg_min(label, item) filter (where opens), arg_min(label, item)) as label, any_value(reasons) as reasons, coalesce(list(item order by item) filter (where not opens), []) as closing, coalesce(list(item order by item) filter (where opens), []) as opening from b3s group by 1, 2, 3)"""
_MADE = """, wa_ as materialized (select ir.*, coalesce(b3s.bundle, (select count(*) from bs where bs.subject_id = ir.subject_id and bs.policy = ir.policy and bs.hi_item < ir.item)) - coalesce(not b3s.opens, false)::int as segment from ir left join b3s on b3s.subject_id = ir.subject_id and b3s.policy = ir.policy and b3s.item = ir.item),
 wb_ as (select subject_id, policy, segment, count(*) as n_items, arg_min(lo, item) as lo, arg_max(hi, item) as hi, arg_max(t_us, item) - arg_min(t_us, item) as us, arg_min(label, item) as first_label, arg_max(label, item) as last_label, arg_min(category, item) as first_category, arg_max(category, item) as last_category from wa_ group by 1, 2, 3),
 wc_ as materialized (select *, row_number() over (partition by subject_id, policy order by segment) - 1 as "window" from wb_),
 ty_ as (select wc_.subject_id, policy, segment, arg_min(tk.type_id, tk.idx) as type_id from wc_ join tk on tk.subject_id = wc_.subject_id and tk.idx between lo and hi where tk.type_id is not null and tk.action in ('open_next', 'close_open') group by 1, 2, 3),
 wm_ as (select wc_.*, hi - lo + 1 as n_tokens, least(hi - lo + 1, 126) + 2 as n_processed, hi - lo + 1 > 126 as truncated, coalesce(type_id, 0) as type_id from wc_ left join ty_ using (subject_id, policy, segment) where "window" < 64)"""


def _judged(spark, d) -> DataFrame:
    return policies.judged(policies.described(decoded(spark, d)))


@query(encoded_sql("select subject_id, policy, bundle::bigint as bundle, lo_item, hi_item, action, label, array_to_string(reasons, ',') as reasons, array_to_string(closing, ',') as closing, array_to_string(opening, ',') as opening from bo_", _JUDGED))
def audit_bundles(spark, d):
    text = lambda c: F.array_join(c, ",").alias(c)
    return policies.boundaries(_judged(spark, d)).select("subject_id", "policy", "bundle", "lo_item", "hi_item", "action", "label", text("reasons"), text("closing"), text("opening"))


@query(encoded_sql('select subject_id, policy, "window", n_items, n_tokens, n_processed, truncated, us, type_id, first_label, last_label, first_category, last_category from wm_', _JUDGED + _MADE))
def audit_windows(spark, d):
    made = policies.windows(_judged(spark, d))
    return made.select("subject_id", "policy", "window", "n_items", "n_tokens", "n_processed", "truncated", F.round(F.col("hours") * 3.6e9).cast("long").alias("us"), "type_id", "first_label", "last_label", "first_category", "last_category")


@query(encoded_sql("select policy, measure, windows, v[1 + round_even(0.5::double * (windows - 1), 0)::int] as p50, v[1 + round_even(0.9::double * (windows - 1), 0)::int] as p90, v[1 + round_even(0.99::double * (windows - 1), 0)::int] as p99, v[windows] as largest, round(u, 6) as unknown_share, round(c, 6) as truncated_share from ms_", _JUDGED + _MADE + ", ml_ as (select policy, truncated, type_id, unnest([{'m': 'n_items', 'v': n_items::double}, {'m': 'n_tokens', 'v': n_tokens::double}, {'m': 'n_processed', 'v': n_processed::double}, {'m': 'hours', 'v': round(greatest(us, 0) / 3600000000, 6)}]) as x from wm_), ms_ as (select policy, x.m as measure, count(*) as windows, list(x.v order by x.v) as v, avg((type_id = 0)::int) as u, avg(truncated::int) as c from ml_ group by 1, 2)"))
def audit_measures(spark, d):
    made = policies.windows(_judged(spark, d)).withColumn("hours", F.round("hours", 6))
    return policies.measures(made).drop("placement").withColumns({c: F.round(c, 6) for c in ("unknown_share", "truncated_share")})


@query(encoded_sql("select * from (select policy, counter, name, count(*) as n, (row_number() over (partition by policy, counter order by count(*) desc, name))::int as rank from ct_ group by 1, 2, 3) where rank <= 20", _JUDGED + _MADE + """, ct_ as (select policy, x.c as counter, x.n as name from (select policy, unnest([{'c': 'opening_label', 'n': first_label}, {'c': 'closing_label', 'n': last_label}, {'c': 'opening_category', 'n': first_category}, {'c': 'closing_category', 'n': last_category}, {'c': 'window_type', 'n': type_id::varchar}]) as x from wm_)
 union all select policy, 'boundary_label', label from bo_ union all select policy, 'boundary_action', action from bo_ union all select policy, 'boundary_reason', unnest(reasons) from bo_)"""))
def audit_counters(spark, d):
    return policies.counters(_judged(spark, d)).drop("placement")


@query(encoded_sql("""select subject_id, policy, row_number() over (partition by subject_id, policy order by segment) - 1 as "window", array_to_string(l[1:3], '|') as first_items, array_to_string(l[greatest(len(l) - 2, 1):], '|') as last_items from (select subject_id, policy, segment, list(label order by item) as l from wa_ where subject_id in (select distinct subject_id from wa_ order by 1 limit 5) group by 1, 2, 3)""", _JUDGED + _MADE))
def audit_previews(spark, d):
    """Of the first five subjects the first and last three items of each window."""
    out = policies.previews(_judged(spark, d), 3, 5)
    return out.select("subject_id", "policy", "window", F.array_join("first_items", "|").alias("first_items"), F.array_join("last_items", "|").alias("last_items"))


@query(recursive(encoded_sql(", kc as (select subject_id, window_ord, chunk_ord, chunk_ord = max(chunk_ord) over (partition by subject_id, window_ord) as top from ck where window_ord < 64 and chunk_ord < 8), mk as (select type_id, top from kc join ws using (subject_id, window_ord)) select kind, value, count(*) as n from (select 'prefix_type' as kind, type_id::varchar as value from mk union all select 'suffix_mode', case when top then 'end' else 'continue' end from mk union all select 'suffix_id', case when top then '17' else '18' end from mk) group by 1, 2", CHUNKED)))
def marker_usage(spark, d):
    return policies.marker_usage(collate.sequences(collated(spark, d), LENGTH))


# --- trajectories ---

_SEEN = "(select arg_max(numeric_value * {}, (t_us, pos)) from ev where ev.subject_id = ax.subject_id and u = '{}' and {} and t_us <= anchor_us)"
_SLICED = f"""{O.BUNDLES}{O.MERGED}{O.WINDOWS}, {TRAJECTORIES}, {STATIC},
 ta as (select tt.*, ws.type_id as own_type, ws.site as own_site, idx = min(idx) over o as head, arg_min(tt.t_us, idx) over o as begin from tt join ws on ws.subject_id = tt.subject_id and ws.window_ord = tt.window_ord window o as (partition by tt.subject_id, trajectory_ord)),
 ax as (select subject_id, trajectory_ord, raw_us as anchor_us from ta where head),
 ay as (select ax.*, sex, birth_us, {_SEEN.format('1', 'BMI (KG/M2)', NUMERIC)} as bmi0, {_SEEN.format('0.45359237', 'WEIGHT (LBS)', NUMERIC)} as kg, {_SEEN.format('2.54', 'HEIGHT (INCHES)', NUMERIC)} as cm from ax join sx using (subject_id)),
 az as (select *, coalesce(bmi0, case when cm > 0 then kg / ((cm / 100.0) * (cm / 100.0)) end) as bmi, (anchor_us - birth_us) / 31557600000000 as age from ay),
 ts as (select subject_id, trajectory_ord, row_number() over (partition by subject_id, trajectory_ord order by o) - 1 as ord, token_id, value from (select subject_id, trajectory_ord, 1 as o, sex as token_id, null::double as value from az union all select subject_id, trajectory_ord, 2, 32 + (age >= 18)::int + (age >= 40)::int + (age >= 65)::int + (age >= 80)::int, null from az where age >= 0
  union all select subject_id, trajectory_ord, 3, 37 + (bmi >= 18.5)::int + (bmi >= 25)::int + (bmi >= 30)::int + (bmi >= 35)::int + (bmi >= 40)::int, null from az where bmi > 0 union all select subject_id, trajectory_ord, 4, 43, cm from az where cm > 0 union all select subject_id, trajectory_ord, 5, 44, kg from az where kg > 0))"""


@query(recursive(encoded_sql("select subject_id, trajectory_ord, ord, token_id, round(value, 6) as value from ts", _SLICED)))
def trajectory_specials(spark, d):
    rows = trajectories.sliced(encoded(spark, d)).where("head")
    return trajectories.specials(with_static(A.meds(spark, d)), rows.select("subject_id", "trajectory_ord", "anchor_us")).withColumn("value", F.round("value", 6))


@query(recursive(encoded_sql("""select subject_id, trajectory_ord, row_number() over (partition by subject_id, trajectory_ord order by part, nth_) - 1 as place, kind, category, gid, round(value, 6) as value, t_us, dt_us, type_id, site, hook from (
 select subject_id, trajectory_ord, 0 as part, ord as nth_, 'SPECIAL' as kind, 'SPECIAL' as category, token_id::bigint as gid, value, 0 as t_us, 0 as dt_us, null::int as type_id, null::varchar as site, false as hook from ts
 union all select subject_id, trajectory_ord, 1, idx, kind, category, gid, value, greatest(t_us - begin, 0), case when head then 0 else dt_us end, case when head then own_type else type_id end, case when head then own_site else site end, hook from ta)""", _SLICED)))
def trajectory_timelines(spark, d):
    made = trajectories.materialised(encoded(spark, d), with_static(A.meds(spark, d)))
    return made.select("subject_id", "trajectory_ord", "place", "kind", "category", "gid", F.round("value", 6).alias("value"), "t_us", "dt_us", "type_id", "site", "hook")


# --- matching, vocabularies, storage ---


def _case(stage: str) -> str:
    return f"coalesce(sum(n) filter (where stage = '{stage}'), 0)::bigint as stage_{stage}"


@query(O.with_ctes(O.coded, CASCADE + f""", fx as (select f.*, category, n from ({FILTERED}) f join (select code, category, count(*) as n from ev group by 1, 2) using (code)),
 fy as (select code, category, n, unnest([{{'k': 'DIAGNOSIS', 'v': dx}}, {{'k': 'PROCEDURE', 'v': px}}, {{'k': 'MEDICATION', 'v': rx}}]) as x from fx),
 fz as (select x.k as category, coalesce(sum(n) filter (where x.v), 0)::bigint as filtered, coalesce(sum(n) filter (where category = x.k), 0)::bigint as routed, coalesce(sum(n) filter (where category = x.k and x.v), 0)::bigint as filtered_routed, coalesce(sum(n) filter (where x.v and category not in ('DIAGNOSIS','PROCEDURE','MEDICATION')), 0)::bigint as mismatched from fy group by 1),
 rz as (select category, coalesce(sum(n) filter (where stage <> 'residual_hash'), 0)::bigint as hits, coalesce(sum(n) filter (where stage = 'residual_hash'), 0)::bigint as misses, {', '.join(map(_case, (*vocab.STAGES, 'unk')))}, count(distinct hit) filter (where stage not in ('residual_exact', 'residual_hash')) as entries_met from rv group by 1)""",
    "select fz.*, rz.* exclude (category), entries, round(entries_met / entries, 6) as entries_share from fz left join rz using (category) left join (select category, count(*) as entries from vo group by 1) using (category)"))
def matching_report(spark, d):
    ev = timeline.classified(A.meds(spark, d))
    codes = scratch.kept(ev.groupBy("code", "category").agg(F.count("*").alias("n")), "codes")
    counts = vocab.with_bases(codes)
    entries = scratch.kept(vocab.sample_vocab(counts), "vocab")
    resolved = vocab.resolve(counts, entries, vocab.sample_parents(counts), vocab.sample_crosswalk(spark), vocab.sample_residual(spark))
    return audit.matching(codes, resolved, entries).withColumn("entries_share", F.round("entries_share", 6))


@query(O.with_ctes(O.coded, CASCADE + f", al as (select category, code, {S.candidates('code')} as l from cc), fi as (select category, l[1] as entry, min(row_number) as o from (select *, row_number() over (order by code) as row_number from al) where len(l) > 0 group by 1, 2), ne as (select category, entry, row_number() over (partition by category order by o) as nth from fi where (category, entry) not in (select category, base from vo))", "select category, base as entry, raw_id from vo union all select category, entry, nth + coalesce((select max(raw_id) from vo where vo.category = ne.category), -1) from ne"))
def vocab_extension(spark, d):
    """Aliases are the codes, in order; their targets the spellings."""
    from ..functions import text as T

    codes = scratch.kept(vocab.code_counts(timeline.classified(A.meds(spark, d))), "codes")
    aliases = codes.select("category", F.col("code").alias("ord"), F.filter(T.bound(F.struct("code", "category"), lambda r: T.candidates(r["code"], r["category"])), lambda x: x.isNotNull()).alias("targets"))
    return vocab.extended(vocab.sample_vocab(codes), aliases)


_SHARDS = 5


@query(O.with_ctes(O.timeline, S.CRC + f", sh as (select subject_id, count(*) as n, any_value({S.crc('subject_id::varchar')} % {_SHARDS})::int as shard from tk, crc_step group by 1)", f"select subject_id, shard, n, row_number() over (partition by shard order by subject_id) - 1 as subject_idx, {SPLIT} as split from sh"))
def shard_index(spark, d):
    t = tokens(spark, d)
    path = f"{scratch.folder(spark)}/shards-{scratch.unique()}"
    return store.write(t, path, A.splits(t), shards=_SHARDS).drop("rel_path")


@query(O.timeline(f"select subject_id, idx, kind, surface, category, t_us, dt_us, hook from tk where {SPLIT} = 'tuning'"))
def shard_split(spark, d):
    """Written in shards, read back by split."""
    t = tokens(spark, d)
    path = f"{scratch.folder(spark)}/shards-{scratch.unique()}"
    store.write(t, path, A.splits(t), shards=_SHARDS)
    return store.read(spark, path, "val").select("subject_id", "idx", "kind", "surface", "category", "t_us", "dt_us", "hook")


@query(O.timeline("select subject_id, idx, kind, surface, category, t_us, dt_us, hook from tk"))
def incremental_timelines(spark, d):
    """Histories that arrive in two halves, the second one twice, compiled as they come."""
    m = A.meds(spark, d).drop("pos")
    path = f"{scratch.folder(spark)}/increments-{scratch.unique()}"
    early = F.col("event_id") % 2 == 0
    increments.compile_batch(m.where(early), path, 4, 0, "extend")
    for _ in range(2):
        increments.compile_batch(m.where(~early), path, 4, 1, "extend")
    return increments.compiled(spark, path).select("subject_id", "idx", "kind", "surface", "category", "t_us", "dt_us", "hook")


# --- another code book ---

#: Rules of a site of its own: two measured codes are structural, one of them only that.
SITE_RULES = {**C.RULES, "labels": {"LAB//50003//mg/dL": "STRUCT_START_X", "LAB//50004//mg/dL": "STRUCT_END_X", "RXNORM//161": "ICU X", "ED_OUT": "STRUCT_END_X"}, "transitions": {"STRUCT_START_X": "open_next", "LAB//50004//mg/dL": "close_current", "TRANSFER_TO": "open_next", "MEDS_DEATH": "suppress"},
              "types": {"STRUCT_START_X": "OR", "TRANSFER_TO": "INPATIENT"}, "boundaries": ("STRUCT_START_X",), "only": ("LAB//50003//mg/dL", "RXNORM//161"), "keep": ("RXNORM//161",)}


def _with_site_rules(sql: str) -> str:
    """The twin of the timeline with the other code book's tables in place of the default's."""
    for key in ("code", "label", "split_part(code, '//', 1)", "p"):
        for name in ("labels", "transitions", "types"):
            sql = sql.replace(O.mapped(key, C.RULES[name]), O.mapped(key, SITE_RULES[name]))
    sql = sql.replace(f"label in ({O.quoted(C.BOUNDARY_LABELS)})", f"label in ({O.quoted(SITE_RULES['boundaries'])})")
    # what is structural only has no other token
    return sql.replace("from ev where category = 'MEASUREMENT'", "from ev where code <> 'LAB//50003//mg/dL' and category = 'MEASUREMENT'")


@query(_with_site_rules(O.timeline("select subject_id, idx, kind, surface, category, action, type_id, hook, t_us, dt_us from tk")))
def timeline_by_rules(spark, d):
    return timeline.tokens(A.meds(spark, d), SITE_RULES).select("subject_id", "idx", "kind", "surface", "category", "action", "type_id", "hook", "t_us", "dt_us")


# --- quantised vectors ---


def _book_rows(spark, d) -> DataFrame:
    """Two levels of sixteen codes, of the vectors with the smallest ids."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id < 32")
    level = (F.col("vec_id") >= 16).cast("int")
    return e.select(level.alias("level"), (F.col("vec_id") % 16).cast("int").alias("code"), F.transform("embedding", lambda x: x.cast("double") / (1 + 3 * level)).alias("vector"))


@query("""with e as (select vec_id, list_transform(embedding, lambda y: y::double) as x from embeddings), bq as (select vec_id // 16 as l, vec_id % 16 as k, list_transform(x, lambda y: y / (1 + 3 * (vec_id // 16))) as v from e where vec_id < 32),
 d0 as (select vec_id, b.k, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - b.v[i]) * (x[i] - b.v[i]))) as d from e, bq b where b.l = 0), n0 as (select vec_id, arg_min(k, d) as k0 from d0 group by 1),
 r1 as (select e.vec_id, k0, list_transform(range(1, len(x) + 1), lambda i: x[i] - v[i]) as x from e join n0 using (vec_id) join bq on l = 0 and k = k0),
 d1 as (select vec_id, k0, b.k, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - b.v[i]) * (x[i] - b.v[i]))) as d from r1, bq b where b.l = 1), n1 as (select vec_id, k0, arg_min(k, d) as k1, min(d) as d from d1 group by 1, 2)
 select vec_id, k0::bigint as k0, k1::bigint as k1, round(d, 4) as rest from n1""")
def vector_codes(spark, d):
    stack = quantise.books(scratch.kept(_book_rows(spark, d), "books"))
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    e = e.withColumn("c", quantise.codes(F.col("v"), stack)).withColumn("back", quantise.restored(F.col("c"), stack))
    rest = F.aggregate(F.zip_with("v", "back", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    return e.select("vec_id", F.col("c")[0].cast("long").alias("k0"), F.col("c")[1].cast("long").alias("k1"), F.round(rest, 4).alias("rest"))
