"""The queries again as plain SQL, written for another engine from the same rules.

Common table expressions, from events to windows; a query names the last one it needs.
"""

from __future__ import annotations

from .. import config as C
from ..sources.adapters import CODE, VALUE, K


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def contains(text: str, parts) -> str:
    return "(" + " or ".join(f"contains({text}, '{p}')" for p in parts) + ")"


def starts(text: str, parts) -> str:
    return "(" + " or ".join(f"starts_with({text}, '{p}')" for p in parts) + ")"


def alias(text: str, parts) -> str:
    return "(" + " or ".join(f"{text} = '{p}' or ends_with({text}, '//{p}')" for p in parts) + ")"


def mapped(key: str, table: dict[str, str]) -> str:
    return f"case {key} " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + " end"


RARE = f"coalesce(not (split_part(u, '//', 1) in ({quoted(C.MODELLED_PREFIXES)})) and {contains('u', C.RARE_CRITICAL)}, false)"
CATEGORY = f"""case when code is null then 'OTHER' when {alias('u', C.MEASUREMENT_ALIASES)} then 'MEASUREMENT' when {alias('u', C.DEMOGRAPHIC_ALIASES)} then 'OTHER'
 when {RARE} then 'STRUCTURAL' when p in ({quoted(C.MEASUREMENT_PREFIXES)}) then 'MEASUREMENT' when {starts('p', C.MEDICATION_STARTS)} then 'MEDICATION'
 when {starts('p', C.PROCEDURE_STARTS)} then 'PROCEDURE' when {starts('p', C.DIAGNOSIS_STARTS)} then 'DIAGNOSIS' when p in ({quoted(C.STRUCTURAL_PREFIXES)}) then 'STRUCTURAL' else 'OTHER' end"""
ICU = contains("u", C.ICU_PLACES)
OR = f"(not {contains('u', C.PERIOP_PLACES)} and (starts_with(u, 'OR_') or {contains('u', C.OR_PLACES)}))"
ED = f"(starts_with(u, 'ED_') or {contains('u', C.ED_PLACES)})"
PLACE = f"case when {ED} then 'ED_ADMISSION' when {ICU} then 'ICU' when {OR} then 'OR' end"
OF_PREFIX = mapped("p", C.TYPE_OF_CODE)
WTYPE = f"""coalesce({mapped('code', C.TYPE_OF_CODE)}, {mapped('label', C.TYPE_OF_CODE)},
 case when p in ('HOSPITAL_ADMISSION','ADMISSION','CAREUNIT_CHANGE','ICU_ADMISSION','ICU_DISCHARGE') and {OF_PREFIX} is not null then {OF_PREFIX} when {PLACE} is not null then {PLACE} else {OF_PREFIX} end,
 case when {contains('label', C.ICU_PLACES)} then 'ICU' when starts_with(label, 'OR_') then 'OR' end)"""


def sited(sites) -> str:
    return "case " + " ".join(f"when s = '{n}' or {contains('s', a)} then '{n}'" for n, a in sites) + " else s end"


SITE = f"""case when s is null and macro is not null then macro || '::' || macro when s <> '' and macro is not null then macro || '::' ||
 case macro when 'ICU' then {sited(C.ICU_SITES)} when 'INPATIENT' then {sited(C.INPATIENT_SITES)} when 'ED_ADMISSION' then 'ED'
 when 'OR' then case when regexp_matches(s, '^OR( |$)') then coalesce(nullif(trim(regexp_replace(s, '^OR( |$)', '')), ''), 'OR') else s end
 when 'POST_DISCHARGE' then 'POST_DISCHARGE' else s end end"""

EVENTS = f"""e0 as (select user_id as subject_id, ts, event_id, event_type, value, {K} as k from events),
m as (select subject_id, event_id, ts as time, epoch_us(ts) as t_us, {CODE} as code, {VALUE} as numeric_value,
 row_number() over (partition by subject_id order by ts, event_id) - 1 as pos from e0)"""
CODES = f""", c0 as (select distinct code, upper(trim(code)) as u, split_part(upper(trim(code)), '//', 1) as p from m),
c1 as (select *, {CATEGORY} as category, {RARE} as rare, {mapped('code', C.STRUCTURAL_LABELS)} as label from c0),
c2 as (select *, coalesce({mapped('code', C.TRANSITIONS)}, {mapped("split_part(code, '//', 1)", C.TRANSITIONS)}, {mapped('label', C.TRANSITIONS)}) as action, {WTYPE} as wtype from c1),
c3 as (select *, coalesce(wtype, case when p = 'ED_REGISTRATION' or {ED} then 'ED_ADMISSION' when p in ('ICU_ADMISSION','ICU_DISCHARGE') or {ICU} then 'ICU'
  when p in ('STRUCT_START_OR','STRUCT_END_OR') or {OR} then 'OR' when p in ('ADMISSION','HOSPITAL_ADMISSION','CAREUNIT_CHANGE','TRANSFER_TO') then 'INPATIENT' end) as macro,
  case when p in ('TRANSFER_TO','ICU_ADMISSION','ED_REGISTRATION','ADMISSION','HOSPITAL_ADMISSION') then trim(regexp_replace(
   coalesce(nullif(substr(u, length(p) + 3), ''), case p when 'ICU_ADMISSION' then 'ICU_ADMISSION' when 'ED_REGISTRATION' then 'ED' when 'TRANSFER_TO' then null else 'ADMISSION' end), '[^A-Z0-9]+', ' ', 'g')) end as s from c2),
c as (select code, u, p, category, rare, label, action, wtype, {mapped('wtype', {k: str(v) for k, v in C.WINDOW_TYPES.items()})}::int as type_id, {SITE} as site,
  p in ({quoted(C.ADMISSION_LIKE)}) as adm, p = 'TRANSFER_TO' as tra, p in ({quoted(C.DISCHARGE_LIKE)}) as dis, p = 'MEDS_DEATH' as dea,
  coalesce(wtype = 'ICU', false) as icu, coalesce(wtype = 'OR', false) as orl from c3),
ev as (select m.*, c.* exclude (code) from m join c using (code))"""
OBS = f"case when upper(trim(split_part(code, '//', 1))) in ({quoted(C.OBSERVATION_PREFIXES)}) then upper(trim(split_part(code, '//', 1))) || '::' || case when contains(code, '//') then trim(split_part(code, '//', 2)) else code end end"
OBS_VALUE = "case when trim(split_part(code, '//', 3)) in ('', 'UNK', 'UNKNOWN') then 'UNK' else trim(split_part(code, '//', 3)) end"
MARK = "case when starts_with(u, 'INFUSION_START//') or contains(u, '//START//') then 'START' when starts_with(u, 'INFUSION_END//') or contains(u, '//END//') then 'END' when contains(u, '//STOP//') then 'STOP' end"
BASE = "case when starts_with(u, 'INFUSION_START//') then 'INFUSION//' || substr(code, 17) when starts_with(u, 'INFUSION_END//') then 'INFUSION//' || substr(code, 15) when contains(u, '//START//') then replace(code, '//START//', '//') when contains(u, '//END//') then replace(code, '//END//', '//') when contains(u, '//STOP//') then replace(code, '//STOP//', '//') else code end"
FINITE = "(numeric_value is not null and isfinite(numeric_value))"
TOKENS = f""", tk0 as (
 select *, 0 as o, 'STRUCT' as kind, case when label is not null then code else p end as surface, cast(null as double) as tv from ev where label is not null or category = 'STRUCTURAL'
 union all select *, 1, 'MEAS', code, numeric_value from ev where category = 'MEASUREMENT' and {FINITE}
 union all select *, 1, 'OBS_CODE', {OBS}, null from ev where category = 'MEASUREMENT' and not {FINITE} and {OBS} is not null
 union all select *, 2, 'OBS_VALUE', {OBS_VALUE}, null from ev where category = 'MEASUREMENT' and not {FINITE} and {OBS} is not null
 union all select *, 1, 'CODE', {BASE}, case when category = 'MEDICATION' then numeric_value end from ev where category in ('DIAGNOSIS','PROCEDURE','MEDICATION')
 union all select *, 2, 'MARK', {MARK}, null from ev where category in ('DIAGNOSIS','PROCEDURE','MEDICATION') and {MARK} is not null),
em as (select subject_id, pos, t_us, max(t_us) over (partition by subject_id order by pos rows between unbounded preceding and 1 preceding) as last_us from (select distinct subject_id, pos, t_us from tk0)),
st as (select subject_id, min(t_us) as start_us from m group by 1),
tk as (select a.subject_id, a.pos, row_number() over (partition by a.subject_id, a.pos order by o) - 1 as tok_ord, row_number() over (partition by a.subject_id order by a.pos, o) - 1 as idx,
  kind, surface, tv as value, case when kind = 'STRUCT' then 'STRUCTURAL' else category end as category, a.t_us as raw_us, a.t_us - start_us as t_us,
  case when o = min(o) over (partition by a.subject_id, a.pos) then coalesce(a.t_us - last_us, 0) else 0 end as dt_us,
  kind = 'STRUCT' and coalesce(label in ({quoted(C.BOUNDARY_LABELS)}), action in ({quoted(C.ACTIVE)}), false) as hook,
  case when kind = 'STRUCT' then action end as action, case when kind = 'STRUCT' then type_id end as type_id, case when kind = 'STRUCT' then site end as site,
  kind = 'STRUCT' and adm as adm, kind = 'STRUCT' and tra as tra, kind = 'STRUCT' and dis as dis, kind = 'STRUCT' and dea as dea, kind = 'STRUCT' and icu as icu, kind = 'STRUCT' and orl as orl
 from tk0 a join em on a.subject_id = em.subject_id and a.pos = em.pos join st on a.subject_id = st.subject_id)"""
H = 3_600_000_000
BUNDLES = f""", cd0 as (select *, sum(case when category in ({quoted(C.CLINICAL)}) then 1 else 0 end) over (partition by subject_id order by idx) as cl from tk),
cd1 as (select *, lag(idx) over w as pi, lag(t_us) over w as pt from cd0 where action in ({quoted(C.ACTIVE)}) window w as (partition by subject_id order by idx)),
cd as (select *, cast(sum(case when idx - pi > {C.BUNDLE_GAP_IDX} or abs(t_us - pt) > {int(C.BUNDLE_GAP_H * H)} then 1 else 0 end) over (partition by subject_id order by idx) as bigint) as bundle from cd1),
b0 as (select subject_id, bundle, min(idx) as lo, max(idx) as hi, min(t_us) as t_lo, max(t_us) as t_hi, min(cl) as c_lo, max(cl) as c_hi, bool_or(adm) as adm, bool_or(dis) as dis, bool_or(dea) as dea from cd group by 1, 2),
b1 as (select *, case when lag(hi) over w is null or dis or dea or lo - lag(hi) over w - 1 > {C.CHAIN_TOKENS} or c_lo > lag(c_hi) over w or t_lo - lag(t_hi) over w > {int(C.CHAIN_GAP_H * H)} then 1 else 0 end as brk from b0 window w as (partition by subject_id order by bundle)),
b2 as (select *, sum(brk) over (partition by subject_id order by bundle) as chain from b1),
b3 as (select *, first(dis and not dea) over (partition by subject_id, chain order by bundle) as open_end, sum(case when brk = 0 and adm then 1 else 0 end) over (partition by subject_id, chain order by bundle) as nth from b2),
b as (select *, cast(sum(case when brk = 1 or (open_end and adm and nth = 1) then 1 else 0 end) over (partition by subject_id order by bundle) - 1 as bigint) as merged from b3),
mc as (select cd.*, b.merged from cd join b using (subject_id, bundle))"""
MERGED = """, t0 as (select subject_id, merged, min(idx) as lo, max(idx) as hi, min(t_us) as t_lo, min(idx) filter (where tra) as ft, min(idx) filter (where action in ('open_next','close_open')) as fo, bool_or(action in ('close_current','close_open')) as cl from mc group by 1, 2),
t1 as (select *, case when ft is not null or (fo is not null and cl) then 'close_open' when fo is not null then 'open_next' else 'close_current' end as bundle_action from t0),
t2 as (select *, case bundle_action when 'close_open' then coalesce(ft, fo) when 'open_next' then lo end as turn from t1),
r0 as (select mc.*, turn from mc join t2 using (subject_id, merged)),
op as (select subject_id, merged, type_id, site from r0 where idx >= turn qualify row_number() over (partition by subject_id, merged order by case when not tra and (icu or orl) then 0 when tra then 1 else 2 end, idx) = 1),
cs as (select subject_id, merged, bool_or(dis) as c_dis, bool_or(dea) as c_dea from r0 where turn is null or idx < turn group by 1, 2),
ou as (select subject_id, merged, min(t_us) as open_us from r0 where idx >= turn group by 1, 2),
t3 as (select t2.*, case when turn is not null then coalesce(op.type_id, 0) when c_dea then 0 when c_dis then 5 else 0 end as type, case when turn is not null then op.site end as site,
  cs.merged is not null as c_any, coalesce(c_dis, false) as c_dis, coalesce(c_dea, false) as c_dea, open_us
 from t2 left join op using (subject_id, merged) left join cs using (subject_id, merged) left join ou using (subject_id, merged)),
mb as (select *, coalesce(turn is not null and type <> 0 and type = lag(type) over w and site is not null and site = lag(site) over w, false) as preserved from t3 window w as (partition by subject_id order by merged))"""
WINDOWS = """, fl as (select subject_id, turn as idx, 1 as rank, type, site as w_site, bundle_action, open_us, preserved from mb where turn is not null
  union all select subject_id, hi + 1, 0, type, null, null, null, false from mb where turn is null),
fs as (select * from fl where not preserved qualify row_number() over (partition by subject_id, idx order by rank desc) = 1),
kp as (select distinct subject_id, idx from fl where preserved),
wt as (select tk.*, fs.type as o_type, fs.w_site, fs.bundle_action as o_action, fs.open_us, (fs.idx is not null or tk.idx = 0) as starts, kp.idx is not null as kept,
  cast(sum(case when fs.idx is not null or tk.idx = 0 then 1 else 0 end) over (partition by tk.subject_id order by tk.idx) - 1 as bigint) as window_ord
 from tk left join fs on tk.subject_id = fs.subject_id and tk.idx = fs.idx left join kp on tk.subject_id = kp.subject_id and tk.idx = kp.idx),
w0 as (select subject_id, window_ord, count(*) as n_tokens, min(idx) as lo, max(idx) as hi, min(t_us) as start_us, max(t_us) as end_us, cast(sum(case when kept and not starts then 1 else 0 end) as bigint) as n_breaks,
  max(case when starts then o_type end) as o_type, max(case when starts then w_site end) as w_site, max(case when starts then o_action end) as opening_action, max(case when starts then open_us end) as opening_us,
  arg_min(coalesce(type_id, -1), idx) as f_type, arg_min(site, idx) filter (where site is not null) as any_site from wt group by 1, 2),
ws as (select w0.subject_id, window_ord, case when coalesce(o_type, 0) <> 0 then o_type else greatest(f_type, 0) end as type_id, coalesce(w_site, any_site) as site, opening_action, opening_us,
  k.bundle_action as closing_action, case when c_any then t_lo end as closing_us, coalesce(c_dis or c_dea, false) as closing_discharge, n_tokens, n_breaks, w0.lo, w0.hi, start_us, end_us
 from w0 left join (select *, coalesce(turn - 1, hi) as e from mb where not preserved and bundle_action <> 'open_next' qualify row_number() over (partition by subject_id, e order by turn is null desc) = 1) k on k.subject_id = w0.subject_id and k.e = w0.hi)"""


def events(select: str) -> str:
    return f"with {EVENTS} {select}"


def coded(select: str) -> str:
    return f"with {EVENTS}{CODES} {select}"


def timeline(select: str) -> str:
    return f"with {EVENTS}{CODES}{TOKENS} {select}"


def bundled(select: str) -> str:
    return f"with {EVENTS}{CODES}{TOKENS}{BUNDLES} {select}"


def segmented(select: str) -> str:
    return f"with {EVENTS}{CODES}{TOKENS}{BUNDLES}{MERGED}{WINDOWS} {select}"


def with_ctes(base, ctes: str, select: str) -> str:
    return base("").rstrip() + ", " + ctes + " " + select
