"""Scalars over code strings: observation surfaces and candidate spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from .routing import normal, starts_any


def bound(value: Column, use) -> Column:
    """use(value), with value evaluated once however often use mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parts(code: Column) -> Column:
    return F.transform(F.split(code, "//"), lambda x: F.trim(x))


def observed_value(raw: Column) -> Column:
    """A text value folded to UNK, N/A or NONE, or its first 96 characters with white
    space collapsed."""
    v = F.trim(F.regexp_replace(raw, r"\s+", " "))
    u = F.upper(v)
    return (
        F.when(raw.isNull() | (v == "") | u.isin("UNKNOWN", "UNK"), "UNK")
        .when(u.isin("N/A", "NA", "NOT APPLICABLE"), "N/A")
        .when(u.isin("NONE", "NULL"), "NONE")
        .otherwise(F.substring(v, 1, 96))
    )


def code_value(code: Column) -> Column:
    """The value that a code carries as its third part, or UNK."""
    p = parts(code)
    return F.when(F.size(p) >= 3, observed_value(F.get(p, F.lit(2)))).otherwise("UNK")


def observation_surface(code: Column) -> Column:
    """PREFIX::ITEM of codes that observe something, else null."""
    p = parts(code)
    first = F.upper(F.get(p, F.lit(0)))
    item = F.when(F.size(p) >= 2, F.get(p, F.lit(1))).otherwise(code)
    return F.when(first.isin(*C.OBSERVATION_PREFIXES), F.concat_ws("::", first, item))


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _spellings(system: Column, code: Column) -> Column:
    """With and without the system, as is, undotted and dotted."""
    bare = F.replace(code, F.lit("."), F.lit(""))
    dotted = F.when(code.contains(".") | (F.length(code) <= 3), code).otherwise(F.concat_ws(".", F.substring(code, 1, 3), F.substring(code, 4, 1 << 20)))
    forms = F.array(code, bare, dotted)
    return F.array_distinct(F.concat(F.transform(forms, lambda x: F.concat_ws("//", system, x)), forms))


def _nothing() -> Column:
    return F.array().cast("array<string>")


def icd(code: Column) -> Column:
    """The ICD code in a string: after a marker if there is one, else the first alike."""
    s = F.regexp_replace(F.upper(code), "ICD-(10|9)", "ICD$1")
    ten, nine = r"[A-TV-Z][0-9][0-9A-Z](?:\.[0-9A-Z]{1,4})?", r"[0-9]{3}(?:\.[0-9A-Z]{1,2})?"
    return F.coalesce(_found(s, rf"ICD10\w*[:/\\|-]*({ten})"), _found(s, rf"ICD9\w*[:/\\|-]*({nine})"), _found(s, rf"\b({ten})\b"), _found(s, rf"\b({nine})\b"))


def diagnosis_candidates(code: Column) -> Column:
    """Spellings to look a diagnosis up by, in order. A code that begins with a letter
    counts as ICD-10, those of ICD-9 too."""
    s = F.upper(code)
    last = F.element_at(F.split(s, "//"), -1)
    found = F.when(starts_any(s, ("DIAGNOSIS//ICD//9//", "DIAGNOSIS//ICD//10//")), last).otherwise(icd(s))
    system = lambda x: F.when(F.substring(x, 1, 1).rlike("[A-Z]"), "ICD10CM").otherwise("ICD9CM")
    return bound(found, lambda x: F.when(F.coalesce(x, F.lit("")) == "", _nothing()).otherwise(_spellings(system(x), x)))


def _prefixed(system: str, *forms: Column) -> Column:
    return F.concat(F.array(*[F.concat_ws("//", F.lit(system), x) for x in forms]), F.array(*forms))


def procedure_candidates(code: Column) -> Column:
    """Spellings to look a procedure up by, in order."""
    s = F.upper(code)
    last = F.element_at(F.split(s, "//"), -1)
    bare = lambda x: F.replace(x, F.lit("."), F.lit(""))
    snomed = lambda x: F.array(x, F.concat(F.lit("SNOMED//"), x), F.concat(F.lit("SNOMED/"), x))
    rest = F.regexp_replace(s, "^PROCEDURE//", "")

    def each(pattern, make):
        x = _found(rest, pattern)
        return F.when(x.isNotNull(), make(x)).otherwise(_nothing())

    loose = F.concat(
        each(r"\b([0-9A-HJ-NP-Z]{7})\b", lambda x: _prefixed("ICD10PCS", x)),
        each(r"\b([0-9]{4,5}[A-Z]?)\b", lambda x: _prefixed("CPT", x)),
        each(r"\b([0-9]{2}\.[0-9]{1,2}|[0-9]{3,4})\b", lambda x: _prefixed("ICD9PROC", x, bare(x))),
        each(r"SNOMED\W*([0-9]{3,18})", snomed),
    )
    out = (
        F.when(code.isNull(), _nothing())
        .when(s.startswith("PROCEDURE//ICD//9//"), _prefixed("ICD9PROC", last, bare(last)))
        .when(s.startswith("PROCEDURE//ICD//10//"), _prefixed("ICD10PCS", last))
        .when(s.startswith("PROCEDURE//CPT//"), _prefixed("CPT", last))
        .when(starts_any(s, ("PROCEDURE//SNOMED//", "SNOMED//")), snomed(last))
        .when(s.startswith("SNOMED/"), snomed(F.element_at(F.split(s, "/"), -1)))
    )
    return F.when(starts_any(s, ("PROCEDURE//ICD//", "PROCEDURE//CPT//", "PROCEDURE//SNOMED//", "SNOMED/")) | code.isNull(), out).otherwise(F.array_distinct(loose))


def medication_parts(code: Column) -> Column:
    """domain, entity and action of a medication or infusion code."""
    p = parts(code)
    head, n = F.upper(F.get(p, F.lit(0))), F.size(p)
    squeezed = lambda x: F.trim(F.regexp_replace(F.upper(x), r"\s+", " "))
    join = lambda a: F.nullif(F.trim(F.array_join(a, "//")), F.lit(""))
    tail = F.slice(p, 2, 999)
    first, last = F.upper(F.get(p, F.lit(1))), squeezed(F.get(p, n - 1))
    drug = head.isin("MEDICATION", "INFUSION")
    marked, suffixed = drug & first.isin("START", "END", "STOP"), drug & (n >= 3) & last.isin(*C.ACTION_SUFFIXES)
    entity = F.when(head.isin("INFUSION_START", "INFUSION_END"), join(tail)).when(marked, join(F.slice(p, 3, 999))).when(suffixed, join(F.slice(p, F.lit(2), F.greatest(n - 2, F.lit(0))))).when(drug, join(tail))
    action = F.when(head == "INFUSION_START", "START").when(head == "INFUSION_END", "END").when(marked, first).when(suffixed, last)
    domain = F.when(head.isin("INFUSION_START", "INFUSION_END"), "INFUSION").otherwise(head)
    return F.struct(domain.alias("domain"), squeezed(entity).alias("entity"), action.alias("action"))


def ndc(code: Column) -> Column:
    """Digits only; ten digits are padded to fourteen, segment by segment."""
    d = F.regexp_replace(code, "[^0-9]", "")
    return F.when(F.length(d) == 10, F.concat(F.lpad(F.substring(d, 1, 1), 5, "0"), F.substring(d, 2, 4), F.substring(d, 6, 5))).otherwise(d)


def medication_candidates(code: Column) -> Column:
    """Spellings to look a medication up by, in order; the code itself is the last."""

    def coded(text):
        rx, nd = _found(text, r"RXNORM\W*([0-9]{3,9})"), _found(text, r"NDC\W*([0-9]{4,5}-?[0-9]{3,4}-?[0-9]{1,2})")
        return F.concat(F.when(rx.isNotNull(), _prefixed("RXNORM", rx)).otherwise(_nothing()), F.when(nd.isNotNull(), _prefixed("NDC", nd, ndc(nd))).otherwise(_nothing()))

    def spelled(m):
        s, entity, domain, action = F.upper(code), m["entity"], m["domain"], m["action"]
        number = F.coalesce(_found(entity, r"\b([0-9]{3,11})\b"), _found(s, r"\b([0-9]{3,11})\b"))
        named = (
            F.when(entity.isNull(), _nothing())
            .when(domain == "MEDICATION", F.array_compact(F.array(F.concat(F.lit("MEDICATION//"), entity), F.when(action.isNotNull(), F.concat(F.lit("MEDICATION//"), entity, F.lit("//"), action)), entity)))
            .when(domain == "INFUSION", F.array(F.concat(F.lit("INFUSION//"), entity), entity))
            .otherwise(F.array(entity))
        )
        explicit = F.concat(coded(s), F.when(entity.isNotNull(), coded(entity)).otherwise(_nothing()))
        return bound(explicit, lambda e: F.concat(F.when((F.size(e) == 0) & number.isNotNull(), _prefixed("RXNORM", number)).otherwise(e), named, F.array(code)))

    return F.when(code.isNull(), _nothing()).otherwise(F.array_distinct(bound(medication_parts(code), spelled)))


def candidates(code: Column, category: Column) -> Column:
    return F.when(category == "DIAGNOSIS", diagnosis_candidates(code)).when(category == "PROCEDURE", procedure_candidates(code)).when(category == "MEDICATION", medication_candidates(code)).otherwise(_nothing())


def without_action(code: Column) -> Column:
    """A medication code without its action: an infix of four parts or more, or a suffix."""
    p = parts(code)
    n, up = F.size(p), F.upper(F.get(parts(code), F.lit(1)))
    infix = (n >= 4) & up.isin("START", "END", "STOP")
    suffix = (n >= 3) & F.upper(F.get(p, n - 1)).isin(*C.ACTION_SUFFIXES)
    cut = F.when(infix, F.concat(F.slice(p, 1, 1), F.slice(p, 3, 999))).when(suffix, F.slice(p, F.lit(1), F.greatest(n - 1, F.lit(0)))).otherwise(p)
    return F.array_join(cut, "//")


def residual_candidates(code: Column, base: Column, category: Column) -> Column:
    """Keys of the residual vocabulary: without action, unmarked, as it came."""
    return F.array_distinct(F.array_compact(F.array(F.when(category == "MEDICATION", normal(without_action(base))), normal(base), normal(code))))


def lexical_key(text: Column) -> Column:
    """Letters and digits only; null if shorter than four or without a letter."""
    k = F.regexp_replace(F.upper(text), "[^A-Z0-9]", "")
    return F.when((F.length(k) >= 4) & k.rlike("[A-Z]"), k)


def aliases(text: Column) -> Column:
    """A text, what stands in its parentheses, and what is left without them."""
    inner = F.regexp_extract_all(text, F.lit(r"\(([^()]*)\)"), F.lit(1))
    outer = F.trim(F.regexp_replace(F.regexp_replace(text, r"\([^()]*\)", " "), r"\s+", " "))
    return F.array_distinct(F.filter(F.concat(F.array(text), inner, F.array(outer)), lambda x: x != ""))


def dot_forms(code: Column) -> Column:
    """A code's letters and digits, plain and with a dot at every place inside."""
    base = F.regexp_replace(F.upper(code), "[^0-9A-Z]", "")
    n = F.length(base)
    dotted = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.substring(base, F.lit(1), i), F.lit("."), F.substring(base, i + 1, n)))
    return F.when(n == 0, _nothing()).when(n == 1, F.array(base)).otherwise(F.concat(F.array(base), dotted))


def low_specificity(code: Column) -> Column:
    """Medication spellings that say too little: empty, unknown, or a short number."""
    c = normal(code)
    short = c.rlike(r"\A(RXNORM//)?[0-9]{1,4}\z")
    return (c == "") | c.isin("UNK", "<UNK>", "MEDICATION//UNK") | short | (c.startswith("NDC//") & (F.length(F.regexp_replace(c, "[^0-9]", "")) < 10))


def simplified(text: Column) -> Column:
    """A medication's words without dose forms, routes and numbers; null if none is left."""
    words = F.regexp_extract_all(F.upper(text), F.lit("[A-Z0-9]+"), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(*C.DOSE_FORM_WORDS) & ~w.rlike("^[0-9]+[A-Z]*$"))
    return F.nullif(F.array_join(kept, " "), F.lit(""))


def _varied(names: Column) -> Column:
    return F.array_distinct(F.concat(names, F.flatten(F.transform(names, lambda x: aliases(x)))))


def medication_aliases(code: Column) -> Column:
    """A medication's names, in order: as it came, its entity, plain and with its domain,
    their variants, and all of them simplified."""
    text = F.trim(code)

    def named(m):
        domain = F.when(m["domain"].isin("MEDICATION", "INFUSION"), F.concat_ws("//", m["domain"], m["entity"]))
        return _varied(F.array_compact(F.array(text, m["entity"], F.when(m["entity"].isNotNull(), domain))))

    with_simple = lambda a: F.concat(a, F.array_compact(F.transform(a, lambda x: simplified(x))))
    return F.when(text == "", _nothing()).otherwise(F.array_distinct(bound(bound(medication_parts(text), named), with_simple)))


def procedure_aliases(code: Column) -> Column:
    """A procedure's names, in order: as it came, without PROCEDURE//, without an interval
    marker, its last part, and their variants."""
    text = F.trim(code)
    rest = F.when(F.upper(text).startswith("PROCEDURE//"), F.substring(text, 12, 1 << 20))
    p = F.filter(F.transform(F.split(rest, "//"), lambda x: F.trim(x)), lambda x: x != "")
    marked = F.upper(F.get(p, F.lit(0))).isin("START", "END", "STOP") & (F.size(p) > 1)
    names = F.array_compact(F.array(text, rest, F.when(marked, F.array_join(F.slice(p, 2, 999), "//")), F.try_element_at(p, F.lit(-1))))
    return F.when(text == "", _nothing()).otherwise(_varied(F.array_distinct(names)))


def lexical_keys(code: Column, category: Column) -> Column:
    """The distinct lexical keys of a code's names, in order."""
    names = F.when(category == "MEDICATION", medication_aliases(code)).when(category == "PROCEDURE", procedure_aliases(code)).otherwise(F.array(code))
    return F.array_distinct(F.array_compact(F.transform(names, lambda x: lexical_key(x))))


def is_diagnosis(code: Column) -> Column:
    """Whether a code may stand in a vocabulary of diagnoses."""
    c = F.upper(code)
    last = F.element_at(F.split(c, "//"), -1)
    found = last.rlike(r"\b[A-TV-Z][0-9][0-9A-Z](?:\.[0-9A-Z]{1,4})?\b") | last.rlike(r"\b[0-9]{3}(?:\.[0-9A-Z]{1,2})?\b")
    other = F.lit(False)
    for x in ("MEDICATION//", "INFUSION", "PROCEDURE//", "DRG//", "CPT//", "HCPCS"):
        other = other | c.contains(x)
    return starts_any(c, ("DIAGNOSIS//ICD//", "ICD10CM", "ICD9CM")) | (~other & ~F.substring_index(c, "//", 1).isin(*C.MEASUREMENT_PREFIXES) & found)


def is_procedure(code: Column) -> Column:
    """Whether a code may stand in a vocabulary of procedures."""
    c = F.upper(code)
    last = F.element_at(F.split(c, "//"), -1)
    found = last.rlike("[0-9]") & (last.rlike("^[0-9A-HJ-NP-Z]{7}$") | last.rlike(r"^([0-9]{2}\.[0-9]{1,2}|[0-9]{3,4})$"))
    other = c.contains("MEDICATION//") | c.contains("INFUSION") | c.contains("DRG//")
    return starts_any(c, ("PROCEDURE//", "ICD10PCS", "ICD9PROC", "CPT", "HCPCS", "SNOMED//", "SNOMED/")) | (~other & ~F.substring_index(c, "//", 1).isin(*C.MEASUREMENT_PREFIXES) & found)


def is_medication(code: Column) -> Column:
    """Whether a code may stand in a vocabulary of medications."""
    c = F.upper(code)
    last = F.element_at(F.split(c, "//"), -1)
    found = last.rlike(r"NDC\W*[0-9]{4,5}-?[0-9]{3,4}-?[0-9]{1,2}") | last.rlike("^[0-9]{3,11}$")
    return starts_any(c, ("RXNORM", "NDC", "MEDICATION//", "INFUSION")) | (~F.substring_index(c, "//", 1).isin(*C.MEASUREMENT_PREFIXES, "PROCEDURE") & found)
