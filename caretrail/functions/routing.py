"""Where an event code belongs, as Column expressions (no Python in the plan)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def normal(code: Column) -> Column:
    """Upper case, without white space around."""
    return F.upper(F.regexp_replace(code, r"^\s+|\s+$", ""))


def prefix(code: Column) -> Column:
    return F.substring_index(code, "//", 1)


def _either(parts: tuple[str, ...]) -> str:
    return "(" + "|".join(re.escape(p) for p in parts) + ")"


def matches_alias(code: Column, aliases: tuple[str, ...]) -> Column:
    return code.rlike(r"(\A|//)" + _either(aliases) + r"\z")


def has_any(text: Column, parts: tuple[str, ...]) -> Column:
    return text.rlike(_either(parts))


def starts_any(text: Column, parts: tuple[str, ...]) -> Column:
    return text.rlike(r"\A" + _either(parts))


def rare_critical(code: Column) -> Column:
    """Rare but acute events outside the modelled families; null codes are not."""
    c = normal(code)
    return F.coalesce(~prefix(c).isin(*C.MODELLED_PREFIXES) & has_any(c, C.RARE_CRITICAL), F.lit(False))


def category(code: Column) -> Column:
    """The code's category; null is OTHER. The first rule that holds decides."""
    c = normal(code)
    p = prefix(c)
    return (
        F.when(code.isNull(), "OTHER")
        .when(matches_alias(c, C.MEASUREMENT_ALIASES), "MEASUREMENT")
        .when(matches_alias(c, C.DEMOGRAPHIC_ALIASES), "OTHER")
        .when(rare_critical(code), "STRUCTURAL")
        .when(p.isin(*C.MEASUREMENT_PREFIXES), "MEASUREMENT")
        .when(starts_any(p, C.MEDICATION_STARTS), "MEDICATION")
        .when(starts_any(p, C.PROCEDURE_STARTS), "PROCEDURE")
        .when(starts_any(p, C.DIAGNOSIS_STARTS), "DIAGNOSIS")
        .when(p.isin(*C.STRUCTURAL_PREFIXES), "STRUCTURAL")
        .otherwise("OTHER")
    )


def lookup(table: dict[str, str], key: Column) -> Column:
    """The entry of a small table of rules, or null."""
    if not table:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def icu_place(upper: Column) -> Column:
    return has_any(upper, C.ICU_PLACES)


def or_place(upper: Column) -> Column:
    return ~has_any(upper, C.PERIOP_PLACES) & (upper.startswith("OR_") | has_any(upper, C.OR_PLACES))


def ed_place(upper: Column) -> Column:
    return upper.startswith("ED_") | has_any(upper, C.ED_PLACES)


def structural_label(code: Column, rules: dict = C.RULES) -> Column:
    return lookup(rules["labels"], code)


def transition_action(code: Column, rules: dict = C.RULES) -> Column:
    """By the code, else its prefix as written, else its structural label."""
    at = rules["transitions"]
    return F.coalesce(lookup(at, code), lookup(at, prefix(code)), lookup(at, structural_label(code, rules)))


def hooked(label: Column, action: Column, rules: dict = C.RULES) -> Column:
    """Whether a structural token bounds a window: by its label if it has one, else its action."""
    return F.coalesce(label.isin(*rules["boundaries"]), action.isin(*C.ACTIVE), F.lit(False))


def structural_only(code: Column, rules: dict = C.RULES) -> Column:
    """Whether an event with this code has no token beside its structural one."""
    alone = [c for c in rules["only"] if c not in set(rules["keep"])]
    return F.coalesce(code.isin(*alone), F.lit(False)) & structural_label(code, rules).isNotNull() if alone else F.lit(False)


def window_type(code: Column, rules: dict = C.RULES) -> Column:
    """Name of the window type that a transition to this code opens, or null."""
    upper, label = F.upper(code), structural_label(code, rules)
    p = prefix(upper)
    by_place = F.when(ed_place(upper), "ED_ADMISSION").when(icu_place(upper), "ICU").when(or_place(upper), "OR")
    known = lookup(rules["types"], p)
    by_code = (
        F.when(p.isin("HOSPITAL_ADMISSION", "ADMISSION", "CAREUNIT_CHANGE", "ICU_ADMISSION", "ICU_DISCHARGE") & known.isNotNull(), known)
        .when(by_place.isNotNull(), by_place)
        .otherwise(known)
    )
    by_label = F.when(icu_place(label), "ICU").when(or_place(label), "OR")
    return F.coalesce(lookup(rules["types"], code), lookup(rules["types"], label), by_code, by_label)


def type_id(name: Column) -> Column:
    return lookup({k: str(v) for k, v in C.WINDOW_TYPES.items()}, name).cast("int")


def site_token(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(text), "[^A-Z0-9]+", " "))


def _canonical(site: Column, sites) -> Column:
    out = F
    for name, aliases in sites:
        out = out.when(site.rlike(_either(aliases) + rf"|\A{name}\z"), name)
    return out.otherwise(site)


def site_name(code: Column, wtype: Column) -> Column:
    """TYPE::SITE of the place that a code names, by the naming rule of its type, which
    is its window type if it has one."""
    upper = F.upper(code)
    p = prefix(upper)
    inferred = (
        F.when((p == "ED_REGISTRATION") | ed_place(upper), "ED_ADMISSION")
        .when(p.isin("ICU_ADMISSION", "ICU_DISCHARGE") | icu_place(upper), "ICU")
        .when(p.isin("STRUCT_START_OR", "STRUCT_END_OR") | or_place(upper), "OR")
        .when(p.isin("ADMISSION", "HOSPITAL_ADMISSION", "CAREUNIT_CHANGE", "TRANSFER_TO"), "INPATIENT")
    )
    macro = F.coalesce(wtype, inferred)
    rest = F.filter(F.transform(F.slice(F.split(code, "//"), 2, 99), lambda x: F.trim(x)), lambda x: x != "")
    fallback = lookup({"ICU_ADMISSION": "ICU_ADMISSION", "ED_REGISTRATION": "ED", "ADMISSION": "ADMISSION", "HOSPITAL_ADMISSION": "ADMISSION"}, p)
    placed = F.when(p.isin("TRANSFER_TO", "ICU_ADMISSION", "ED_REGISTRATION", "ADMISSION", "HOSPITAL_ADMISSION"), F.when(F.size(rest) > 0, F.array_join(rest, " // ")).otherwise(fallback))
    site = site_token(placed)
    stripped = F.trim(F.regexp_replace(site, "^OR( |$)", ""))
    named = (
        F.when(macro == "ICU", _canonical(site, C.ICU_SITES))
        .when(macro == "INPATIENT", _canonical(site, C.INPATIENT_SITES))
        .when(macro == "ED_ADMISSION", F.lit("ED"))
        .when(macro == "OR", F.when(site.rlike("^OR( |$)"), F.when(stripped == "", "OR").otherwise(stripped)).otherwise(site))
        .when(macro == "POST_DISCHARGE", F.lit("POST_DISCHARGE"))
        .otherwise(site)
    )
    return F.when(placed.isNull() & macro.isNotNull(), F.concat_ws("::", macro, macro)).when((site != "") & macro.isNotNull(), F.concat_ws("::", macro, named))


def site_id(name: Column) -> Column:
    """A stable positive number for a site's name."""
    return F.lit(1) + F.crc32(F.encode(name, "UTF-8")).bitwiseAND(F.lit(0x7FFFFFFF))


def family_of_id(gid: Column) -> Column:
    """The family whose id range holds a global id."""
    out = F.lit(None).cast("string")
    for name, offset in sorted(C.FAMILY_OFFSETS.items(), key=lambda kv: kv[1]):
        out = F.when(gid >= offset, name).otherwise(out)
    return out


def marker(code: Column) -> Column:
    """START, END or STOP of an interval that a medication, infusion or procedure code
    marks, or null."""
    c = F.upper(code)
    return (
        F.when(c.startswith("INFUSION_START//"), "START").when(c.startswith("INFUSION_END//"), "END")
        .when(c.contains("//START//"), "START").when(c.contains("//END//"), "END").when(c.contains("//STOP//"), "STOP")
    )


def unmarked(code: Column) -> Column:
    """The code without its first interval marker."""
    c = F.upper(code)

    def without(m: str) -> Column:
        at = F.locate(m, c)
        return F.concat(F.substring(code, F.lit(1), at + 1), F.substring(code, at + len(m), F.length(code)))

    out = F.when(c.startswith("INFUSION_START//"), F.concat(F.lit("INFUSION//"), F.substring(code, 17, 1 << 20)))
    out = out.when(c.startswith("INFUSION_END//"), F.concat(F.lit("INFUSION//"), F.substring(code, 15, 1 << 20)))
    for m in ("//START//", "//END//", "//STOP//"):
        out = out.when(c.contains(m), without(m))
    return out.otherwise(code)
