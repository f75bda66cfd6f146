"""Spellings, names and the resolution cascade once more, as SQL expressions.

Written from the rules, not from their Spark form; every function takes and returns the
text of an expression. They hold for any code, so the queries that use them can be compared
on tables of any size.
"""

from __future__ import annotations

from .. import config as C
from . import oracle as O

_names = iter(f"v{i}" for i in range(1 << 30))


def let(value: str, body) -> str:
    """body(name) with value bound to a name."""
    v = next(_names)
    return f"list_transform([{value}], lambda {v}: {body(v)})[1]"


def unique(items: str) -> str:
    a, i = next(_names), next(_names)
    return let(items, lambda x: f"list_filter({x}, lambda {a}, {i}: {a} is not null and list_position({x}, {a}) = {i})")


def some(items: str) -> str:
    a = next(_names)
    return f"list_filter({items}, lambda {a}: {a} is not null)"


def found(text: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({text}, '{pattern}', {group}), '')"


def parts(code: str) -> str:
    a = next(_names)
    return f"list_transform(string_split({code}, '//'), lambda {a}: trim({a}))"


def last(code: str) -> str:
    return f"list_last(string_split({code}, '//'))"


def bare(x: str) -> str:
    return f"replace({x}, '.', '')"


def prefixed(system: str, *forms: str) -> str:
    return "[" + ", ".join([f"'{system}//' || {x}" for x in forms] + list(forms)) + "]"


_TEN, _NINE = r"[A-TV-Z][0-9][0-9A-Z](?:\.[0-9A-Z]{1,4})?", r"[0-9]{3}(?:\.[0-9A-Z]{1,2})?"


def icd(code: str) -> str:
    def body(s):
        tries = [found(s, rf"ICD10\w*[:/\\|-]*({_TEN})"), found(s, rf"ICD9\w*[:/\\|-]*({_NINE})"), found(s, rf"\b({_TEN})\b"), found(s, rf"\b({_NINE})\b")]
        return f"coalesce({', '.join(tries)})"

    return let(f"regexp_replace(upper({code}), 'ICD-(10|9)', 'ICD\\1', 'g')", body)


def diagnosis(code: str) -> str:
    def spelled(x):
        dotted = f"case when contains({x}, '.') or length({x}) <= 3 then {x} else {x}[1:3] || '.' || {x}[4:] end"
        system = f"case when regexp_matches({x}[1:1], '[A-Z]') then 'ICD10CM' else 'ICD9CM' end"
        f = next(_names)
        forms = let(f"[{x}, {bare(x)}, {dotted}]", lambda y: let(system, lambda s: unique(f"list_concat(list_transform({y}, lambda {f}: {s} || '//' || {f}), {y})")))
        return f"case when coalesce({x}, '') = '' then []::varchar[] else {forms} end"

    own = f"case when regexp_matches(upper({code}), '^DIAGNOSIS//ICD//(9|10)//') then {last(f'upper({code})')} else {icd(code)} end"
    return let(own, spelled)


def procedure(code: str) -> str:
    snomed = lambda x: f"[{x}, 'SNOMED//' || {x}, 'SNOMED/' || {x}]"

    def body(s):
        rest = f"regexp_replace({s}, '^PROCEDURE//', '')"

        def each(pattern, make):
            return let(found(rest, pattern), lambda x: f"case when {x} is null then []::varchar[] else {make(x)} end")

        loose = [
            each(r"\b([0-9A-HJ-NP-Z]{7})\b", lambda x: prefixed("ICD10PCS", x)), each(r"\b([0-9]{4,5}[A-Z]?)\b", lambda x: prefixed("CPT", x)),
            each(r"\b([0-9]{2}\.[0-9]{1,2}|[0-9]{3,4})\b", lambda x: prefixed("ICD9PROC", x, bare(x))), each(r"SNOMED\W*([0-9]{3,18})", snomed),
        ]
        joined = loose[0]
        for x in loose[1:]:
            joined = f"list_concat({joined}, {x})"
        z = last(s)
        return f"""case when {s} is null then []::varchar[] when starts_with({s}, 'PROCEDURE//ICD//9//') then {prefixed('ICD9PROC', z, bare(z))} when starts_with({s}, 'PROCEDURE//ICD//10//') then {prefixed('ICD10PCS', z)}
 when starts_with({s}, 'PROCEDURE//ICD//') then null when starts_with({s}, 'PROCEDURE//CPT//') then {prefixed('CPT', z)} when starts_with({s}, 'PROCEDURE//SNOMED//') or starts_with({s}, 'SNOMED//') then {snomed(z)}
 when starts_with({s}, 'SNOMED/') then {snomed(f"list_last(string_split({s}, '/'))")} else {unique(joined)} end"""

    return let(f"upper({code})", body)


def squeezed(x: str) -> str:
    return f"trim(regexp_replace(upper({x}), '\\s+', ' ', 'g'))"


def drug(code: str) -> str:
    """A struct of domain, entity and action."""
    join = lambda a: f"nullif(trim(array_to_string({a}, '//')), '')"

    def body(p):
        head, first, end, n = f"upper({p}[1])", f"upper({p}[2])", squeezed(f"{p}[len({p})]"), f"len({p})"
        is_drug, process = f"{head} in ('MEDICATION', 'INFUSION')", f"{head} in ('INFUSION_START', 'INFUSION_END')"
        marked, suffixed = f"({is_drug} and coalesce({first} in ('START', 'END', 'STOP'), false))", f"({is_drug} and {n} >= 3 and {end} in ({O.quoted(C.ACTION_SUFFIXES)}))"
        entity = f"case when {process} then {join(f'{p}[2:]')} when {marked} then {join(f'{p}[3:]')} when {suffixed} then {join(f'{p}[2:{n} - 1]')} when {is_drug} then {join(f'{p}[2:]')} end"
        action = f"case {head} when 'INFUSION_START' then 'START' when 'INFUSION_END' then 'END' else case when {marked} then {first} when {suffixed} then {end} end end"
        return f"{{'domain': case when {process} then 'INFUSION' else {head} end, 'entity': {squeezed(entity)}, 'action': {action}}}"

    return let(parts(code), body)


def ndc(x: str) -> str:
    return let(f"regexp_replace({x}, '[^0-9]', '', 'g')", lambda d: f"case when length({d}) = 10 then lpad({d}[1:1], 5, '0') || {d}[2:5] || {d}[6:10] else {d} end")


def medication(code: str) -> str:
    def coded(text):
        rx = let(found(text, r"RXNORM\W*([0-9]{3,9})"), lambda x: f"case when {x} is null then []::varchar[] else {prefixed('RXNORM', x)} end")
        nd = let(found(text, r"NDC\W*([0-9]{4,5}-?[0-9]{3,4}-?[0-9]{1,2})"), lambda x: f"case when {x} is null then []::varchar[] else {let(ndc(x), lambda y: prefixed('NDC', x, y))} end")
        return f"list_concat({rx}, {nd})"

    def body(m):
        entity, domain, action = f"{m}.entity", f"{m}.domain", f"{m}.action"
        number = f"coalesce({found(entity, r'\b([0-9]{3,11})\b')}, {found(f'upper({code})', r'\b([0-9]{3,11})\b')})"
        medic = some(f"['MEDICATION//' || {entity}, 'MEDICATION//' || {entity} || '//' || {action}, {entity}]")
        named = f"case when {entity} is null then []::varchar[] when {domain} = 'MEDICATION' then {medic} when {domain} = 'INFUSION' then ['INFUSION//' || {entity}, {entity}] else [{entity}] end"
        explicit = f"list_concat({coded(f'upper({code})')}, case when {entity} is null then []::varchar[] else {coded(entity)} end)"
        start = let(explicit, lambda e: let(number, lambda k: f"case when len({e}) = 0 and {k} is not null then {prefixed('RXNORM', k)} else {e} end"))
        return unique(f"list_concat(list_concat({start}, {named}), [{code}])")

    return let(drug(code), body)


def candidates(code: str, category: str = "category") -> str:
    return f"case {category} when 'DIAGNOSIS' then {diagnosis(code)} when 'PROCEDURE' then {procedure(code)} when 'MEDICATION' then {medication(code)} end"


def without_action(code: str) -> str:
    def body(p):
        n = f"len({p})"
        infix = f"({n} >= 4 and upper({p}[2]) in ('START', 'END', 'STOP'))"
        suffix = f"({n} >= 3 and upper({p}[{n}]) in ({O.quoted(C.ACTION_SUFFIXES)}))"
        return f"array_to_string(case when {infix} then list_concat({p}[1:1], {p}[3:]) when {suffix} then {p}[1:{n} - 1] else {p} end, '//')"

    return let(parts(code), body)


def residual_keys(code: str, base: str) -> str:
    return unique(f"[case when category = 'MEDICATION' then upper(trim({without_action(base)})) end, upper(trim({base})), upper(trim({code}))]")


def key(text: str) -> str:
    return let(f"regexp_replace(upper({text}), '[^A-Z0-9]', '', 'g')", lambda k: f"case when length({k}) >= 4 and regexp_matches({k}, '[A-Z]') then {k} end")


def aliases(text: str) -> str:
    a = next(_names)
    outer = f"trim(regexp_replace(regexp_replace({text}, '\\([^()]*\\)', ' ', 'g'), '\\s+', ' ', 'g'))"
    return unique(f"list_filter(list_concat(list_concat([{text}], regexp_extract_all({text}, '\\(([^()]*)\\)', 1)), [{outer}]), lambda {a}: {a} <> '')")


def varied(names: str) -> str:
    a = next(_names)
    return let(names, lambda x: unique(f"list_concat({x}, flatten(list_transform({x}, lambda {a}: {aliases(a)})))"))


def simplified(text: str) -> str:
    w = next(_names)
    return f"nullif(array_to_string(list_filter(regexp_extract_all(upper({text}), '[A-Z0-9]+'), lambda {w}: {w} not in ({O.quoted(C.DOSE_FORM_WORDS)}) and not regexp_matches({w}, '^[0-9]+[A-Z]*$')), ' '), '')"


def medication_names(code: str) -> str:
    a = next(_names)

    def body(t):
        own = let(drug(t), lambda m: varied(some(f"[{t}, {m}.entity, case when {m}.domain in ('MEDICATION', 'INFUSION') then {m}.domain || '//' || {m}.entity end]")))
        return f"case when {t} = '' then []::varchar[] else {let(own, lambda x: unique(f'list_concat({x}, list_transform({x}, lambda {a}: {simplified(a)}))'))} end"

    return let(f"trim({code})", body)


def procedure_names(code: str) -> str:
    a = next(_names)

    def body(t):
        rest = f"case when starts_with(upper({t}), 'PROCEDURE//') then {t}[12:] end"
        bits = f"list_filter({parts(rest)}, lambda {a}: {a} <> '')"
        names = let(rest, lambda r: let(bits, lambda p: varied(unique(f"[{t}, {r}, case when upper({p}[1]) in ('START', 'END', 'STOP') and len({p}) > 1 then array_to_string({p}[2:], '//') end, {p}[len({p})]]"))))
        return f"case when {t} = '' then []::varchar[] else {names} end"

    return let(f"trim({code})", body)


def keys(code: str, category: str = "category") -> str:
    a = next(_names)
    names = f"case {category} when 'MEDICATION' then {medication_names(code)} when 'PROCEDURE' then {procedure_names(code)} else [{code}] end"
    return unique(f"list_transform({names}, lambda {a}: {key(a)})")


CRC = "crc_step as (select list(list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(3988292384::bigint, c >> 1) else c >> 1 end, i) order by i) as t from range(256) x(i))"


def crc(text: str) -> str:
    """The CRC-32 of a text in UTF-8, by the table t of CRC."""
    i, c, x = (next(_names) for _ in range(3))
    octets = let(f"hex(encode({text}))", lambda h: f"list_transform(range(1, len({h}), 2), lambda {i}: ('0x' || {h}[{i}:{i} + 1])::bigint)")
    return f"xor(list_reduce({octets}, lambda {c}, {x}: xor(t[xor({c} & 255, {x}) + 1], {c} >> 8), 4294967295::bigint), 4294967295::bigint)"


def numbered(name: str, source: str, items: str, columns: str) -> str:
    """A table of columns, place (from 0) and entry of each of the items of source's rows."""
    return f"{name}0 as materialized (select {columns}, {items} as l from {source}), {name} as (select {columns}, i - 1 as place, l[i] as entry from (select *, unnest(range(1, len(l) + 1)) as i from {name}0))"


def cascade(vocab: str, parents: str, labels: str, residual: str, stages: tuple[str, ...]) -> str:
    """Tables cc (category, code, base, n) and rv (category, code, n, stage, hit, gid) of the
    coded events ev, by vocab(category, base, raw_id), parents(category, key, parent),
    labels(category, label, target, ord) and residual(category, entry, raw_id)."""
    at = C.FAMILY_OFFSETS
    offset = lambda s: f"case category when 'DIAGNOSIS' then {at['diagnosis' + s]} when 'PROCEDURE' then {at['procedure' + s]} else {at['medication' + s]} end"
    return f"""cc as materialized (select category, code, any_value({O.BASE}) as base, count(*) as n from ev where category in ('DIAGNOSIS','PROCEDURE','MEDICATION') group by 1, 2),
 {numbered('p0', 'cc', '[base, code]', 'category, code')}, {numbered('p1', 'cc', candidates('base'), 'category, code')},
 pk as (select distinct category, code, unnest([upper(code), upper(base), upper({without_action('code')})]) as key from cc),
 pp as (select pk.category, pk.code, parent from pk join {parents} using (category, key)),
 {numbered('p2', 'pp', f"list_concat([parent], {candidates('parent')})", 'category, code')}, {numbered('lk', 'cc', keys('code'), 'category, code')},
 la as (select category, target, ord, unnest({aliases('label')}) as alias from {labels}), lt as (select category, {key('alias')} as key, arg_min(target, ord) as target from la where {key('alias')} is not null group by 1, 2 having count(distinct target) = 1),
 lb as (select category, {key(last('base'))} as key, min(base) as target from {vocab} where {key(last('base'))} is not null group by 1, 2 having count(distinct base) = 1),
 {numbered('p5', 'cc', residual_keys('code', 'base'), 'category, code')},
 tr as (select category, code, 0 as s, place, entry from p0 union all select category, code, 1, place, entry from p1 union all select category, code, 2, place, entry from p2
  union all select lk.category, code, 3, place, target from lk join lt on lt.category = lk.category and lt.key = entry union all select lk.category, code, 4, place, target from lk join lb on lb.category = lk.category and lb.key = entry),
 ht as (select tr.category, code, s, place, entry, raw_id + {offset('').replace('category', 'tr.category')} as gid from tr join {vocab} v on v.base = entry and v.category = tr.category
  union all select p5.category, code, 5, place, entry, raw_id + {offset('_residual').replace('category', 'p5.category')} from p5 join {residual} r using (category, entry)),
 bh as (select category, code, arg_min({{'s': s, 'entry': entry, 'gid': gid}}, s * 1000 + place) as b from ht group by 1, 2),
 rk5 as (select category, code, entry from p5 where place = 0), {CRC},
 rv as (select cc.category, cc.code, n, case when b is null then 'residual_hash' else [{O.quoted(stages)}][b.s + 1] end as stage, coalesce(b.entry, rk5.entry) as hit,
  coalesce(b.gid, {crc('rk5.entry')} % {C.RESIDUAL_BUCKETS} + 1 + {offset('_residual').replace('category', 'cc.category')})::bigint as gid from cc join rk5 using (category, code) left join bh using (category, code), crc_step)"""
