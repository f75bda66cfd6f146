"""More queries over the shared test tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import numeric as N
from ..functions import routing as R
from ..functions import text as T
from ..operators import audit, collate, ids, segments, vocab
from ..sources import adapters as A
from ..sources import loaders as L
from . import oracle as O
from . import spelling as S
from .queries import CASCADE, CODE2ID, DT, NUMERIC, STATS, SURFACE, chunked, coded, query, recursive, tokens
from .queries import TRAJECTORIES as FOLLOWED

#: CRC-32 in SQL: a table of the bytes' remainders, and the sum of a text of ASCII.
CRC = "crct as (select list(v order by i) as t from (select i, list_reduce(list_concat([i::bigint], list_transform(range(8), lambda x: x::bigint)), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as v from (select unnest(range(256)) as i)))"


def crc(text: str) -> str:
    return f"xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split({text}, ''), lambda c: ord(c)::bigint)), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295)"


OBS_LANE = C.FAMILY_OFFSETS["observation_value"] - C.FAMILY_OFFSETS["observation_code"] - 1
OBSERVED = f"ob as (select subject_id, pos, {O.OBS} as cs, {O.OBS_VALUE} as vs from ev where {O.OBS} is not null)"
RESERVED = O.mapped("upper(vs)", {k: str(v) for k, v in C.OBSERVATION_VALUES.items()})

# --- token ids ---


@query(O.with_ctes(O.coded, f"{CRC}, {OBSERVED}", f"select subject_id, pos, {C.FAMILY_OFFSETS['observation_code']} + 1 + {crc('cs')} % {OBS_LANE} as code_gid, {C.FAMILY_OFFSETS['observation_value']} + coalesce(({RESERVED})::bigint, 1 + {crc(chr(39) + 'OBS_VAL::' + chr(39) + ' || vs')} % {C.OBSERVATION_VALUE_LANE}) as value_gid from ob, crct"))
def observation_hash_ids(spark, d):
    return ids.observation_ids(A.meds(spark, d)).select("subject_id", "pos", "code_gid", "value_gid")


@query(O.with_ctes(O.coded, f"{OBSERVED}, k as (select cs, row_number() over (order by cs) as r from (select distinct cs from ob)), q as (select vs, row_number() over (order by vs) as r from (select distinct vs from ob))", f"select subject_id, pos, {C.FAMILY_OFFSETS['observation_code']} + k.r as code_gid, {C.FAMILY_OFFSETS['observation_value']} + q.r as value_gid from ob join k using (cs) join q using (vs) where k.r <= 12"))
def observation_exact_ids(spark, d):
    m = A.meds(spark, d)
    seen = m.select(T.observation_surface(F.col("code")).alias("c"), T.code_value(F.col("code")).alias("v")).where("c is not null")
    listed = lambda c: vocab.numbered(seen.select(F.lit("x").alias("category"), F.col(c).alias("entry")).distinct()).select(F.col("entry").alias("surface"), "raw_id")
    return ids.observation_ids(m, listed("c").where("raw_id <= 12"), listed("v"), "drop").select("subject_id", "pos", "code_gid", "value_gid")


PROCESS = f"""pr as (select subject_id, pos, case when starts_with(u, 'INFUSION_START//') then 'START' when starts_with(u, 'INFUSION_END//') then 'END' else split_part(u, '//', 2) end as action,
 case when starts_with(u, 'INFUSION_') then 'INFUSION' else p end as domain, case when starts_with(u, 'INFUSION_') then substr(code, strpos(code, '//') + 2) else substr(code, length(p) + length(split_part(u, '//', 2)) + 5) end as entity
 from ev where starts_with(u, 'INFUSION_START//') or starts_with(u, 'INFUSION_END//') or (p in ('MEDICATION','PROCEDURE') and split_part(u, '//', 2) in ('START','END','STOP') and split_part(u, '//', 3) <> ''))"""


@query(O.with_ctes(O.coded, f"{CRC}, {PROCESS}", f"select subject_id, pos, action, domain, {C.PROCESS_ACTION_OFFSET} + case action when 'START' then 1 when 'END' then 2 else 3 end as action_gid, {C.PROCESS_ENTITY_OFFSET} + case when regexp_matches(entity, '^[0-9]+$') then try_cast(entity as bigint) else 1 + {crc(chr(39).join(['domain || ', '::', ' || entity']))} % {C.ENTITY_LANE} end as entity_gid from pr, crct"))
def process_token_ids(spark, d):
    return ids.process_ids(A.meds(spark, d))


@query(O.with_ctes(O.coded, CRC, f"select distinct site, 1 + ({crc('site')} & 2147483647) as site_id from c, crct where site is not null"))
def site_ids(spark, d):
    return coded(spark, d).where("site is not null").select("site").distinct().select("site", R.site_id(F.col("site")).alias("site_id"))


GIDS = "gi as (select l_partkey * 1300 + l_linenumber as gid from lineitem)"


def gids(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_partkey") * 1300 + F.col("l_linenumber")).cast("long").alias("gid"))


@query(f"with {GIDS} select family, count(*) as n from (select case " + " ".join(f"when gid >= {C.FAMILY_OFFSETS[k]} then '{v}'" for k, v in (("observation_value", "observation_value"), ("observation_code", "observation_code"), ("structural", "structural"), ("measurement_value", "measurement_value"), ("measurement_code", "measurement_code"), ("medication", "medication_or_med_attr"), ("procedure", "procedure"), ("diagnosis", "diagnosis"))) + " else 'special_or_window' end as family from gi) group by 1")
def family_counts(spark, d):
    return gids(spark, d).groupBy(ids.family(F.col("gid")).alias("family")).agg(F.count("*").alias("n"))


#: Sizes of the blocks in the tests; medication wraps around at half of its size.
SIZES = {"special": 100, "structural": 50, "measurement_code": 2_000, "measurement_value": 512, "observation_code": 300, "observation_value": 300, "diagnosis": 90_000, "diagnosis_residual": 40_000, "procedure": 90_000, "procedure_residual": 40_000, "medication": 90_000, "medication_residual": 40_000}
HALVED = {"medication": 45_000}
BLOCKS = "bk0 as (select * from (values " + ", ".join(f"('{n}', '{C.BLOCK_LANES[n]}', {C.LANES.index(C.BLOCK_LANES[n])}, {i}, {C.FAMILY_OFFSETS[n]}, {SIZES[n]}, {HALVED.get(n, SIZES[n])})" for i, n in enumerate(C.BLOCK_LANES)) + ") t(name, lane, lane_ord, ord, global_offset, source_size, dense_size)), bk as (select *, sum(dense_size) over (order by lane_ord, ord) - dense_size as dense_offset from bk0)"


#: Block sizes that the table's ids ask for; medication wraps around at half of its own.
NEEDED = f"{GIDS}, {BLOCKS}, nb0 as (select name, lane, lane_ord, ord, global_offset, max(gid) - global_offset + 1 as source_size from gi join bk on gid between global_offset and global_offset + source_size - 1 group by 1, 2, 3, 4, 5), nb1 as (select *, case when name = 'medication' then (source_size + 1) // 2 else source_size end as dense_size from nb0), nb as (select *, sum(dense_size) over (order by lane_ord, ord) - dense_size as dense_offset from nb1)"


def needed(spark, d) -> DataFrame:
    """The layout of as many ids as the table needs; a row a block."""
    hit = ids.remapped(gids(spark, d), ids.layout(spark, SIZES)).where("block is not null").groupBy("block").agg(F.max("gid").alias("top"))
    sizes = {r.block: r.top - C.FAMILY_OFFSETS[r.block] + 1 for r in hit.collect()}
    return ids.layout(spark, sizes, {n: (x + 1) // 2 for n, x in sizes.items() if n == "medication"})


@query(f"with {NEEDED} select name, lane, global_offset::bigint as global_offset, source_size::bigint as source_size, dense_size::bigint as dense_size, case when dense_size < source_size then 'modulo' else 'identity' end as mode, dense_offset::bigint as dense_offset from nb")
def runtime_layout(spark, d):
    return needed(spark, d).drop("lane_ord", "ord")


@query(f"with {GIDS}, {BLOCKS} select gid, name as block, coalesce(dense_offset + (gid - global_offset) % dense_size, 0)::bigint as dense_id from gi left join bk on gid between global_offset and global_offset + source_size - 1")
def remap_ranges(spark, d):
    return ids.remapped(gids(spark, d), ids.layout(spark, SIZES, HALVED))


COMPACT = f"""{GIDS}, {BLOCKS}, sn as (select distinct name, gid from gi join bk on gid between global_offset and global_offset + source_size - 1 where name <> 'special'),
 kp as (select * from sn union all select name, global_offset from bk where name <> 'special' and name not in (select name from sn)),
 cz as (select bk.name, lane_ord, ord, coalesce(n, dense_size) as size from bk left join (select name, count(*) as n from kp group by 1) k using (name)),
 co as (select name, sum(size) over (order by lane_ord, ord) - size as dense_offset, size from cz),
 ct as (select gid, name, dense_offset + row_number() over (partition by name order by gid) - 1 as dense_id from kp join co using (name))"""


@query(f"with {COMPACT} select name, dense_offset::bigint as dense_offset, size::bigint as dense_size from co")
def compact_layout(spark, d):
    return ids.compacted(ids.layout(spark, SIZES, HALVED), gids(spark, d), ("special",))[0].select("name", "dense_offset", "dense_size")


@query(f"with {COMPACT} select x.gid, ct.name as block, coalesce(ct.dense_id, 0)::bigint as dense_id from (select * from gi union all select gid + 1 from gi) x left join ct using (gid) where x.gid >= 100")
def remap_lookup(spark, d):
    blocks, table = ids.compacted(ids.layout(spark, SIZES, HALVED), gids(spark, d), ("special",))
    both = gids(spark, d).union(gids(spark, d).select(F.col("gid") + 1))
    return ids.remapped(both.where("gid >= 100"), blocks, table)


@query(f"with {GIDS}, {BLOCKS} select name as block, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from gi left join bk on gid between global_offset and global_offset + source_size - 1 group by 1")
def remap_share(spark, d):
    return ids.remap_stats(ids.remapped(gids(spark, d), ids.layout(spark, SIZES, HALVED)))


ODD = "ob0 as (select 'line ' || l_linenumber as name, min(l_partkey) * 100 + l_linenumber * 40 as global_offset, max(l_suppkey) - min(l_suppkey) - case when l_linenumber = 5 then 1000000 else 0 end as source_size, count(*) - case when l_linenumber = 6 then 1000000000 else 0 end as dense_size, case when l_linenumber = 7 then 'other' else 'identity' end as mode from lineitem group by l_linenumber)"


@query(f"with {ODD}, ob1 as (select *, lag(global_offset + source_size - 1) over (order by global_offset, name) as before from ob0) select name, case when source_size <= 0 then 'source_size' when dense_size <= 0 then 'dense_size' when mode = 'other' then 'mode' when global_offset <= before then 'overlap' end as problem from ob1 where source_size <= 0 or dense_size <= 0 or mode = 'other' or global_offset <= before")
def layout_problems(spark, d):
    n = F.col("l_linenumber")
    less = lambda i, x: F.when(n == i, x).otherwise(0)
    rows = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(n).agg((F.min("l_partkey") * 100 + n * 40).cast("long").alias("global_offset"), (F.max("l_suppkey") - F.min("l_suppkey")).alias("s"), F.count("*").alias("k"))
    blocks = rows.select(F.concat(F.lit("line "), n.cast("string")).alias("name"), "global_offset", (F.col("s") - less(5, 1_000_000)).cast("long").alias("source_size"), (F.col("k") - less(6, 1_000_000_000)).cast("long").alias("dense_size"), F.when(n == 7, "other").otherwise("identity").alias("mode"))
    return ids.problems(blocks)


@query(f"with {COMPACT}, lx as (select gid, name, dense_id from ct union all select gid, name, dense_id + 1 from ct where gid % 7 = 0 union all select gid + 500000000, name, dense_id from ct where gid % 11 = 0), cb as (select name, case when name in (select name from sn) then (select min(gid) from kp where kp.name = co.name) end as lo, (select max(gid) from kp where kp.name = co.name) as hi, dense_offset, size from co), lz as (select lx.*, case when not (gid between coalesce(lo, hi) and hi) then 'gid outside' when not (dense_id between dense_offset and dense_offset + size - 1) then 'dense_id outside' end as problem from lx join cb using (name)) select name, problem, count(*) as n from lz where problem is not null group by 1, 2 union all select name, 'gid repeated', count(*) from (select name, gid from lx group by 1, 2 having count(*) > 1) group by 1 union all select name, 'dense_id repeated', count(*) from (select name, dense_id from lx group by 1, 2 having count(*) > 1) group by 1")
def lookup_problems(spark, d):
    """A compact table, spoilt: some ids twice, some out of place."""
    blocks, table = ids.compacted(ids.layout(spark, SIZES, HALVED), gids(spark, d), ("special",))
    again = table.where("gid % 7 = 0").withColumn("dense_id", F.col("dense_id") + 1)
    away = table.where("gid % 11 = 0").withColumn("gid", F.col("gid") + 500_000_000)
    return ids.lookup_problems(blocks, table.unionByName(again).unionByName(away))


META = f"{COMPACT}, mx as (select name as block, dense_id, gid as sparse_id, gid = off as first from ct join (select name, global_offset as off from bk) b using (name) union all select 'special', i, i, i = 0 from range(100) r(i))"


@query(f"with {META} select dense_id::bigint as dense_id, block, case regexp_extract(block, '^[a-z]+') when 'special' then 0 when 'structural' then 5 when 'measurement' then 1 when 'observation' then 1 when 'diagnosis' then 2 when 'procedure' then 3 else 4 end as category_id, sparse_id::bigint as sparse_id, case when block = 'special' and (dense_id between 10 and 15 or dense_id in (17, 18)) then 'special_marker' when dense_id = 0 then 'unk' when block = 'special' then null when first then 'unk' else block end as family from mx")
def dense_metadata(spark, d):
    blocks, table = ids.compacted(ids.layout(spark, SIZES, HALVED), gids(spark, d), ("special",))
    return ids.dense_metadata(blocks, table)


@query("select l_orderkey, l_linenumber, (2100000 + (l_linenumber % 2) * 256 + l_partkey % 256)::bigint as token, (l_linenumber % 2)::bigint as level, (l_partkey % 256)::bigint as code from lineitem")
def level_ids(spark, d):
    x = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", N.level_id(C.FAMILY_OFFSETS["measurement_value"], F.col("l_linenumber") % 2, 256, F.col("l_partkey") % 256).cast("long").alias("token"))
    level, code = N.level_code(F.col("token"), C.FAMILY_OFFSETS["measurement_value"], 256)
    return x.withColumns({"level": level.cast("long"), "code": code})


# --- names and filters ---


@query(f"select p_name, nullif(array_to_string(list_filter(regexp_extract_all(upper(p_name || ' 5MG oral tablet'), '[A-Z0-9]+'), lambda w: w not in ({O.quoted(C.DOSE_FORM_WORDS)}) and not regexp_matches(w, '^[0-9]+[A-Z]*$')), ' '), '') as simple from part")
def simplified_names(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_name", T.simplified(F.concat("p_name", F.lit(" 5MG oral tablet"))).alias("simple"))


MEAS_PREFIX = O.quoted(C.MEASUREMENT_PREFIXES)


#: code, dx, px and rx: which families' filters keep a code.
FILTERED = f"""select code, starts_with(u, 'DIAGNOSIS//ICD//') or starts_with(u, 'ICD10CM') or starts_with(u, 'ICD9CM') or (not {O.contains('u', ('MEDICATION//', 'INFUSION', 'PROCEDURE//', 'DRG//', 'CPT//', 'HCPCS'))} and p not in ({MEAS_PREFIX}) and (regexp_matches(list_last(string_split(u, '//')), '\\b[A-TV-Z][0-9][0-9A-Z](\\.[0-9A-Z]{{1,4}})?\\b') or regexp_matches(list_last(string_split(u, '//')), '\\b[0-9]{{3}}(\\.[0-9A-Z]{{1,2}})?\\b'))) as dx,
 {O.starts('u', ('PROCEDURE//', 'ICD10PCS', 'ICD9PROC', 'CPT', 'HCPCS', 'SNOMED//', 'SNOMED/'))} or (not {O.contains('u', ('MEDICATION//', 'INFUSION', 'DRG//'))} and p not in ({MEAS_PREFIX}) and regexp_matches(list_last(string_split(u, '//')), '[0-9]') and regexp_matches(list_last(string_split(u, '//')), '^([0-9A-HJ-NP-Z]{{7}}|[0-9]{{2}}\\.[0-9]{{1,2}}|[0-9]{{3,4}})$')) as px,
 {O.starts('u', ('RXNORM', 'NDC', 'MEDICATION//', 'INFUSION'))} or (p not in ({MEAS_PREFIX}, 'PROCEDURE') and (regexp_matches(list_last(string_split(u, '//')), 'NDC\\W*[0-9]{{4,5}}-?[0-9]{{3,4}}-?[0-9]{{1,2}}') or regexp_matches(list_last(string_split(u, '//')), '^[0-9]{{3,11}}$'))) as rx from c"""


@query(O.coded(FILTERED))
def code_filters(spark, d):
    c = F.col("code")
    return A.meds(spark, d).select("code").distinct().select("code", T.is_diagnosis(c).alias("dx"), T.is_procedure(c).alias("px"), T.is_medication(c).alias("rx"))


@query(O.coded(f"select code, {O.contains('upper(code)', C.RARE_KEYWORDS)} as rare, {O.contains('upper(code)', C.CRITICAL_KEYWORDS)} as critical from c"))
def keyword_flags(spark, d):
    u = F.upper("code")
    return A.meds(spark, d).select("code").distinct().select("code", R.has_any(u, C.RARE_KEYWORDS).alias("rare"), R.has_any(u, C.CRITICAL_KEYWORDS).alias("critical"))


@query(O.coded("select code, starts_with(u, 'ED_') or contains(u, '//ED//') or contains(u, 'EMERGENCY DEPARTMENT') or contains(u, 'EMERGENCY ROOM') as ed, " + O.ICU + "::int as icu, " + O.OR + "::int as orl from c"))
def pathway_flags(spark, d):
    u = F.upper("code")
    return A.meds(spark, d).select("code").distinct().select("code", R.ed_place(u).alias("ed"), R.icu_place(u).cast("int").alias("icu"), R.or_place(u).cast("int").alias("orl"))


SPELLED = "(values ('RXNORM'), ('SNOMED'), ('NDC'), ('CPT4'), ('HCPCS'), ('ICD10PCS'), ('ICD9PROC'), ('other')) t(system)"


@query(f"select p_partkey, system, case system when 'RXNORM' then k || '|RXNORM//' || k when 'SNOMED' then k || '|SNOMED//' || k || '|SNOMED/' || k when 'NDC' then 'NDC//' || k || '|' || k when 'CPT4' then 'CPT//' || k || '|' || k when 'HCPCS' then 'HCPCS//' || k || '|' || k when 'ICD10PCS' then 'ICD10PCS//' || k || '|' || k when 'ICD9PROC' then 'ICD9PROC//' || k || '|' || k || '|' || replace(k, '.', '') else '' end as spellings from (select p_partkey, p_partkey || '.5' as k from part), {SPELLED}")
def system_spellings(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.explode(F.array(*map(F.lit, (*(s for s in C.SYSTEM_SPELLINGS if s != "ICD9_PROC"), "other")))).alias("system"))
    return part.select("p_partkey", "system", F.array_join(L.spellings(F.col("system"), F.concat(F.col("p_partkey").cast("string"), F.lit(".5"))), "|").alias("spellings"))


@query("select p_partkey, x as parent from (select p_partkey, unnest(list_distinct(['RXNORM//' || p_partkey % 7, p_brand])) as x from part)")
def parent_codes(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    cell = F.concat(F.lit("['RXNORM//"), (F.col("p_partkey") % 7).cast("string"), F.lit("', ' "), F.col("p_brand"), F.lit(" ', '"), F.col("p_brand"), F.lit("', '']"))
    return L.parents(part.select(F.col("p_partkey").cast("string").alias("code"), cell.alias("parent_codes")), "MEDICATION").select(F.col("key").cast("long").alias("p_partkey"), "parent")


_LOW = "(upper(trim(entry)) in ('', 'UNK', '<UNK>', 'MEDICATION//UNK') or regexp_matches(upper(trim(entry)), '^(RXNORM//)?[0-9]{1,4}$') or (starts_with(upper(trim(entry)), 'NDC//') and length(regexp_replace(upper(trim(entry)), '[^0-9]', '', 'g')) < 10))"
#: fl (category, code, target): first spelling in the vocabulary, else what the labels say.
FULL = f"""{CASCADE}, {S.numbered('pc', 'cc', S.candidates('code'), 'category, code')},
 fh as (select pc.category, code, arg_min(entry, place) as hit from pc join vo on vo.category = pc.category and vo.base = entry where raw_id <> 0 and (pc.category <> 'MEDICATION' or not {_LOW}) group by 1, 2),
 fo as (select lk.category, code, arg_min(target, place) as other from lk join lt on lt.category = lk.category and lt.key = lk.entry group by 1, 2),
 fl as (select category, code, coalesce(hit, other) as target from cc left join fh using (category, code) left join fo using (category, code))"""


@query(O.with_ctes(O.coded, FULL, "select * from fl"))
def full_targets(spark, d):
    ev = coded(spark, d)
    return vocab.full_target(ev, vocab.sample_vocab(ev), vocab.sample_crosswalk(spark))


@query(O.with_ctes(O.coded, FULL, "select category, code, n, code in (select code from pc join vo on vo.category = pc.category and vo.base = entry where pc.category = cc.category) as hit from cc"))
def matched_codes(spark, d):
    ev = coded(spark, d)
    return vocab.matched(ev, vocab.sample_vocab(ev))


@query(O.with_ctes(O.coded, FULL + f", lf as (select cc.* from cc join fl using (category, code) where target is null and {O.MARK.replace('u, ', 'upper(code), ')} is null), lg as (select category, {S.residual_keys('code', 'code')}[1] as entry, sum(n)::bigint as n from lf group by 1, 2), lh as (select *, row_number() over w as raw_id, coalesce(sum(n) over (partition by category order by n desc, entry rows between unbounded preceding and 1 preceding), 0) as before, sum(n) over (partition by category) as total from lg window w as (partition by category order by n desc, entry))", "select category, entry, n, raw_id from lh where raw_id <= 100 and (raw_id = 1 or before / total < 0.9)"))
def residual_vocab(spark, d):
    ev = coded(spark, d)
    return vocab.residual_vocab(ev, vocab.sample_vocab(ev), vocab.sample_crosswalk(spark), 0.9, 100)


# --- numbers ---


@query("select l_orderkey, l_linenumber, regexp_replace(regexp_replace(printf('%.3f', l_extendedprice::double), '0+$', ''), '\\.$', '') as surface from lineitem")
def number_surfaces(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", N.number_text(F.col("l_extendedprice").cast("double")).alias("surface"))


@query("select event_id, round(ln(1 + least(greatest(value, 0), 672)), 6) as gap, round(least(greatest(value, 0), 100) / 100, 6) as age from events")
def model_inputs(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.round(N.gap_input(F.col("value")), 6).alias("gap"), F.round(N.age_input(F.col("value")), 6).alias("age"))


@query(O.with_ctes(O.coded, CODE2ID + ", " + STATS, "select i as var_id, round(coalesce(mean, 0), 6) as mean, round(coalesce(std, 1), 6) as std, coalesce(n, 0) as n from (select unnest(range(1, 61)) as i) left join vs on var_id = i"))
def stats_of_all_ids(spark, d):
    ev = coded(spark, d)
    s = audit.stats_by_id(audit.variable_stats(ev, audit.measurement_ids(ev, 5)), 60)
    return s.select("var_id", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query(O.with_ctes(O.coded, CODE2ID, "select lim as limit, count(*) filter (where n <= lim) as codes, round(avg((n <= lim)::int), 6) as share from c2i, (select unnest([1, 10, 100, 1000]) as lim) group by 1").replace("as limit", 'as "limit"'))
def sparsity_thresholds(spark, d):
    return audit.thresholds(audit.measurement_ids(coded(spark, d), 5), (1, 10, 100, 1000))


@query("select l_suppkey as var_id, count(*) as n, round(avg(abs(l_quantity - l_extendedprice / 2000)), 6) as mae from lineitem group by 1 order by avg(abs(l_quantity - l_extendedprice / 2000)) desc, 1 limit 5")
def worst_variables(spark, d):
    x = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("var_id"), F.col("l_quantity").cast("double").alias("value"), (F.col("l_extendedprice") / 2000).cast("double").alias("predicted"))
    return audit.worst(audit.error_metrics(x, 1), "mae", 5).select("var_id", "n", F.round("mae", 6).alias("mae"))


# --- reports ---


@query(O.with_ctes(O.coded, DT, "select code, events_total - captured_events as uncaptured_events, subjects_with_code, events_total from dt order by 2 desc, 3 desc, 4 desc, 1 limit 20"))
def worst_codes(spark, d):
    return audit.worst_codes(audit.decision_table(coded(spark, d), 1), 20).select("code", "uncaptured_events", "subjects_with_code", "events_total")


@query(O.coded("select category, subject_id, pos, code, row_number() over (partition by category order by subject_id, pos) as nth from ev qualify nth <= 3"))
def first_examples(spark, d):
    return audit.examples(coded(spark, d), "category", 3, "subject_id", "pos").select("category", "subject_id", "pos", "code", "nth")


@query(O.with_ctes(O.coded, DT + f", su as (select *, {SURFACE} as surface from dt)", f"select surface, {O.mapped('surface', C.SURFACE_PATHS)} as path, count(*) as codes from su group by 1, 2"))
def surface_paths(spark, d):
    return audit.surface_paths(audit.decision_table(coded(spark, d), 1))


@query(O.with_ctes(O.timeline, "sz as (select subject_id, pos, count(*) as size, count(*) filter (where kind = 'STRUCT') as st, count(*) filter (where kind = 'MEAS') as me, count(*) filter (where kind = 'OBS_CODE') as oc, count(*) filter (where kind = 'CODE') as co, count(*) filter (where kind = 'MARK') as ma from tk group by 1, 2), s1 as (select subject_id, count(*) as emitted, sum(size) as tokens, count(*) filter (where size = 1) as single, count(*) filter (where size = 2) as pairs, count(*) filter (where size > 2) as larger, sum(st) as st, sum(me) as me, sum(oc) as oc, sum(co) as co, sum(ma) as ma from sz group by 1), e1 as (select subject_id, count(*) as events, count(*) filter (where category = 'OTHER') as unrouted from ev group by 1)", "select subject_id, events, unrouted, coalesce(emitted, 0) as emitted, coalesce(tokens, 0)::bigint as tokens, coalesce(single, 0) as single, coalesce(pairs, 0) as pairs, coalesce(larger, 0) as larger, coalesce(st, 0)::bigint as struct, coalesce(me, 0)::bigint as meas, coalesce(oc, 0)::bigint as obs_code, coalesce(co, 0)::bigint as code, coalesce(ma, 0)::bigint as mark, events - coalesce(emitted, 0) as dropped from e1 left join s1 using (subject_id)").replace("as struct", 'as "struct"'))
def token_flow(spark, d):
    return audit.token_flow(coded(spark, d), tokens(spark, d))


@query(O.with_ctes(O.timeline, f"fc as (select subject_id, min(idx) filter (where action in ({O.quoted(C.ACTIVE)})) as first from tk group by 1)", f"select subject_id, count(*) filter (where first is null or idx < first) as tokens, count(*) filter (where (first is null or idx < first) and category in ({O.quoted(C.CLINICAL)})) as clinical, bool_or(first is not null) as has_transition from tk join fc using (subject_id) group by 1"))
def leading_spans(spark, d):
    return audit.leading(tokens(spark, d))


@query(O.bundled("select split_part(upper(surface), '//', 1) as prefix, action, count(*) as n, count(distinct (subject_id, bundle)) as bundles, count(distinct subject_id) as subjects from cd group by 1, 2"))
def bundle_prefixes(spark, d):
    return audit.bundle_prefixes(segments.bundles(tokens(spark, d)))


@query(O.with_ctes(O.bundled, "bp as (select distinct subject_id, bundle, split_part(upper(surface), '//', 1) as p from cd)", "select x.p as a, y.p as b, count(*) as n from bp x join bp y on x.subject_id = y.subject_id and x.bundle = y.bundle and x.p < y.p group by 1, 2"))
def bundle_pairs(spark, d):
    return audit.bundle_pairs(segments.bundles(tokens(spark, d)))


_TEXT = "upper(surface || ' | ' || case when hook then 'HOOK' else '' end || ' | ' || category)"
_GAP = f"coalesce(idx > 0 and dt_us >= 6 * {O.H}, false)"
_MOVES = f"(category = 'STRUCTURAL' and coalesce(action in ({O.quoted(C.ACTIVE)}), false))"
_TESTS = dict(zip(audit.POLICIES, ("hook", "category = 'STRUCTURAL'", _GAP, f"hook or {_GAP}", f"category = 'STRUCTURAL' or {_GAP}", _MOVES, f"{_MOVES} or {_GAP}", f"{_MOVES} or {O.contains(_TEXT, C.MARKER_PARTS)}", f"{_MOVES} or {O.contains(_TEXT, C.MARKER_PARTS)} or {_GAP}", O.contains(_TEXT, ("ICU",)), f"{O.contains(_TEXT, ('ICU',))} or {_GAP}"), strict=True))
MEASURES = "pm as (" + " union all ".join(f"select subject_id, idx, t_us, '{k}' as policy, {v} as hit from tk" for k, v in _TESTS.items()) + f"""),
 ph as (select *, lag(idx) over w as pi, lag(t_us) over w as pt from pm where hit window w as (partition by policy, subject_id order by idx)),
 pb as (select policy, subject_id, idx from ph where pi is null or idx - pi > {C.BUNDLE_GAP_IDX} or abs(t_us - pt) > {int(C.BUNDLE_GAP_H * O.H)}),
 pw as (select pm.policy, pm.subject_id, pm.t_us, pb.idx is not null as bound, sum((pm.idx = 0 or pb.idx is not null)::int) over (partition by pm.policy, pm.subject_id order by pm.idx) as w from pm left join pb using (policy, subject_id, idx)),
 ps as (select policy, subject_id, w, count(*)::double as tokens, floor((max(t_us) - min(t_us)) / {O.H})::double as hours, bool_or(bound) as bound from pw group by 1, 2, 3),
 pl as (select policy, 'tokens' as measure, list(tokens order by tokens) as v, count(*) as windows, count(*) filter (where bound) as boundaries from ps group by 1 union all select policy, 'hours', list(hours order by hours), count(*), count(*) filter (where bound) from ps group by 1)"""


@query(O.with_ctes(O.timeline, MEASURES, "select policy, measure, windows, boundaries, v[1 + round_even(0.5::double * (len(v) - 1), 0)::int] as p50, v[1 + round_even(0.9::double * (len(v) - 1), 0)::int] as p90, v[1 + round_even(0.99::double * (len(v) - 1), 0)::int] as p99, v[len(v)] as largest from pl"))
def policy_measures(spark, d):
    return audit.policy_measures(tokens(spark, d))


# --- targets, trajectories, storage ---

TARGET = max(C.CHUNK_MIN, int(C.CHUNK_MAX * C.CHUNK_FRACTION))
PLACED = "select wt.*, ck.chunk_ord from (select *, row_number() over (partition by subject_id, window_ord order by idx) - 1 as nth from wt) wt join ck on ck.subject_id = wt.subject_id and ck.window_ord = wt.window_ord and nth >= from_pos and nth < from_pos + len"


@query(chunked(f"select subject_id, window_ord, chunk_ord, count(*) as n_tokens, max(t_us) - min(t_us) as span_us, min(t_us) - min(min(t_us)) over (partition by subject_id, window_ord) as offset_us, chunk_ord = max(chunk_ord) over (partition by subject_id, window_ord) as ends_window from ({PLACED}) group by 1, 2, 3", C.CHUNK_MAX, TARGET, C.CHUNK_TAIL, True))
def chunk_targets(spark, d):
    return collate.chunk_targets(collate.chunk_tokens(tokens(spark, d)))


@query(chunked(f"select subject_id, idx, window_ord, chunk_ord, surface, lead(surface) over w as next_surface, lead(idx) over w is null as chunk_end from ({PLACED}) window w as (partition by subject_id, window_ord, chunk_ord order by idx)", C.CHUNK_MAX, TARGET, C.CHUNK_TAIL, True))
def chunk_next_tokens(spark, d):
    return collate.chunk_next(collate.chunk_tokens(tokens(spark, d)))


@query(O.segmented("select subject_id, window_ord, type_id, n_tokens, end_us - start_us as span_us, lead(type_id) over w as next_type, lead(n_tokens) over w as next_tokens, lead(window_ord) over w is not null as has_next from ws window w as (partition by subject_id order by window_ord)"))
def window_targets(spark, d):
    return collate.window_targets(segments.windows(tokens(spark, d)))


@query(O.segmented("select subject_id, window_ord, case when lead(type_id) over w is not null then 10 + lead(type_id) over w else 17 end as suffix from ws window w as (partition by subject_id order by window_ord)"))
def next_type_suffix(spark, d):
    w = collate.next_types(segments.windows(tokens(spark, d)))
    return w.select("subject_id", "window_ord", collate.chunk_suffix(F.lit(True), F.col("next_type"), "next_type").alias("suffix"))


@query(O.timeline("select subject_id, idx, case when value is not null and isfinite(value) then value else 0 end as value, (value is not null and isfinite(value))::int as has_value from tk"))
def numeric_channel(spark, d):
    value, mask = collate.numeric_channel(F.col("value"))
    return tokens(spark, d).select("subject_id", "idx", value.alias("value"), mask.alias("has_value"))


@query(recursive(O.with_ctes(O.segmented, FOLLOWED + ", ti as (select subject_id, trajectory_ord, count(*) as n_tokens from tt group by 1, 2)", "select *, row_number() over (order by subject_id, trajectory_ord) - 1 as trajectory_id, (row_number() over (order by subject_id, trajectory_ord) - 1) // 512 as shard from ti")))
def trajectory_index(spark, d):
    return collate.trajectory_index(segments.trajectory_clock(tokens(spark, d)))


@query(O.timeline("select subject_id, idx, array_to_string(list_filter([" + ", ".join(f"case when {c} then '{c}=1' end" for c in ("adm", "dea", "dis", "icu", "orl", "tra")) + ", 'type_id=' || type_id], lambda x: x is not null), ',') as attrs from tk"))
def csr_roundtrip(spark, d):
    t = tokens(spark, d).drop("edl")
    back = collate.uncsr(collate.csr(t.select("subject_id", "idx", collate.attributes(t).alias("attrs")), 16))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return back.select("subject_id", "idx", text.alias("attrs"))


@query(O.events("select subject_id, count(*) as n from m where subject_id in (1, 2, 5) group by 1"))
def explicit_subjects(spark, d):
    return A.meds(spark, d).join(A.listed("1,2, 5,", spark), "subject_id", "left_semi").groupBy("subject_id").agg(F.count("*").alias("n"))


@query(O.events("select distinct subject_id from m order by 1 limit 7"))
def first_subjects(spark, d):
    return A.chosen(A.meds(spark, d), 7, "first")


@query(O.events("select subject_id from (select distinct subject_id from m) order by md5('13:' || subject_id), subject_id limit 7"))
def sampled_subjects(spark, d):
    return A.chosen(A.meds(spark, d), 7, "random", 13)


@query("select o_custkey as subject_id, count(*) as n, count(distinct time) as times from (select o_custkey, o_orderdate::timestamp as time from orders union all select o_custkey, l_shipdate::timestamp from lineitem join orders on l_orderkey = o_orderkey) group by 1")
def tied_events(spark, d):
    return A.meds_ties(spark, d).groupBy("subject_id").agg(F.count("*").alias("n"), F.count_distinct("time").alias("times"))


@query(O.coded(f"select category, count(*) filter (where {NUMERIC}) as numeric_events, count(distinct code) as codes from ev group by 1"))
def numeric_by_category(spark, d):
    return coded(spark, d).groupBy("category").agg(F.count_if(N.finite(F.col("numeric_value"))).alias("numeric_events"), F.count_distinct("code").alias("codes"))
