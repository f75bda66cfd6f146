"""Decoding and boundary policies against a sequential reading on random histories."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from caretrail import config as C
from caretrail.operators import decode, policies

CODE, VALUE = C.FAMILY_OFFSETS["measurement_code"], C.FAMILY_OFFSETS["measurement_value"]
TOKEN = "subject_id long, idx long, kind string, category string, gid long, level int, surface string, label string, value double, t_us long, dt_us long, hook boolean, action string, type_id int"


def history(r, subject):
    out, t = [], 0
    for i in range(r.randint(1, 40)):
        kind = r.choice(["MEAS", "VALUE", "VALUE", "OBS_CODE", "OBS_VALUE", "CODE", "STRUCT"])
        gid = {"MEAS": CODE + r.randint(1, 9), "VALUE": VALUE + r.randint(0, 31), "OBS_CODE": 2_300_005, "OBS_VALUE": 2_320_009, "CODE": 1_000_003, "STRUCT": 2_200_001}[kind]
        cat = {"CODE": "DIAGNOSIS", "STRUCT": "STRUCTURAL"}.get(kind, "MEASUREMENT")
        t += r.choice([0, 0, 1, 30])
        out.append((subject, 3 * i, kind, cat, gid, r.randint(0, 1) if kind == "VALUE" else None, kind, None, 1.0, t, 0, False, None, None))
    return out


def sequential(rows, levels):
    def is_value(x):
        return x[3] == "MEASUREMENT" and (x[5] is not None or x[4] >= VALUE)

    out, i = [], 0
    while i < len(rows):
        x, j = rows[i], i + 1
        if x[2] == "OBS_CODE" and j < len(rows) and rows[j][2] == "OBS_VALUE":
            out.append(("observation_bundle", i, j))
            i += 2
            continue
        if x[3] == "MEASUREMENT" and x[2] not in ("OBS_CODE", "OBS_VALUE") and x[5] is None and CODE <= x[4] < VALUE:
            while j < len(rows) and is_value(rows[j]) and (levels is None or j - i <= levels):
                j += 1
            out.append(("measurement_bundle", i, j - 1))
            i = j
            continue
        out.append(("token", i, i))
        i += 1
    return out


@pytest.mark.parametrize("levels", [1, 2, 3, None])
def test_items_like_sequential(spark, levels):
    r = random.Random(levels or 9)
    held = {s: history(r, s) for s in range(60)}
    df = spark.createDataFrame([x for h in held.values() for x in h], TOKEN).repartition(3)
    known = spark.createDataFrame([(CODE + 1, "one")], "gid long, name string")
    got = {}
    for x in decode.items(df, known, levels, 16).orderBy("subject_id", "item").collect():
        got.setdefault(x.subject_id, []).append(x)
    for s, h in held.items():
        assert [(x.item_kind, x.lo, x.hi) for x in got[s]] == sequential(h, levels), s
        for x in got[s]:
            if x.item_kind == "measurement_bundle":
                assert x.codes == [(h[k][4] - VALUE) % 16 for k in range(x.lo + 1, x.hi + 1)]
                assert x.label == ("one" if x.gid == CODE + 1 else None)
            if x.item_kind == "observation_bundle":
                assert x.value_gid == h[x.hi][4]


def test_dense_ids_back(spark):
    blocks = spark.createDataFrame([("special", 0, 4, 4, 0, "identity"), ("diagnosis", 1000, 10, 5, 4, "modulo"), ("medication", 2000, 50, 2, 9, "lookup")], "name string, global_offset long, source_size long, dense_size long, dense_offset long, mode string")
    table = spark.createDataFrame([(2003, "medication", 9), (2040, "medication", 10)], "gid long, name string, dense_id long")
    got = decode.sparse(spark.createDataFrame([(i,) for i in (0, 3, 4, 8, 9, 10, 11)], "dense_id long"), blocks, table).orderBy("dense_id").collect()
    assert [(x.dense_id, x.block, x.gid, x.exact) for x in got] == [(0, "special", 0, True), (3, "special", 3, True), (4, "diagnosis", 1000, False), (8, "diagnosis", 1004, False), (9, "medication", 2003, True), (10, "medication", 2040, True), (11, None, None, False)]


ITEM = "subject_id long, item long, item_kind string, category string, gid long, label string, hook boolean, action string, type_id int, t_us long, dt_us long, lo long, hi long"
H = 3_600_000_000


def story(r, subject):
    out, t, lo = [], 0, 0
    for i in range(r.randint(1, 30)):
        dt = r.choice([0, 0, H // 4, H // 4, H, 7 * H])
        t += dt
        action = r.choice([None, None, None, "open_next", "close_current", "close_open", "suppress"])
        n = r.randint(1, 3)
        structural = action is not None or r.random() < 0.1
        out.append((subject, i, "token", "STRUCTURAL" if structural else "DIAGNOSIS", i, r.choice(["A", "MICU", "x//START//y"]), r.random() < 0.2, action, r.choice([None, 2, 3]), t, dt, lo, lo + n - 1))
        lo += n
    return out


def plain(items, reasons_of, placement):
    """Bundles and windows, item by item."""
    bundles = []
    for i, x in enumerate(items):
        why = reasons_of(x)
        if why:
            b = bundles[-1] if bundles else None
            if b and i - b["last"] <= 2 and abs(x[9] - items[b["last"]][9]) <= H // 2:
                b["last"] = i
                b["why"] += [w for w in why if w not in b["why"]]
            else:
                bundles.append({"first": i, "last": i, "why": list(why)})
    found, made, now = [], [], []
    at = {b["first"]: b for b in bundles}
    i = 0
    while i < len(items):
        if i not in at:
            now.append(i)
            i += 1
            continue
        b = at[i]
        span = range(b["first"], b["last"] + 1)
        acts = {items[k][7] for k in span if items[k][7] in C.ACTIVE}
        action = "close_open" if "close_open" in acts or len(acts) == 2 else acts.pop() if acts else "open_next" if any(w.startswith("gap") for w in b["why"]) else placement
        closing, opening, seen = [], [], False
        for k in span:
            role = items[k][7]
            to_open = action == "open_next" or (action == "close_open" and (role == "open_next" or (role != "close_current" and seen)))
            (opening if to_open else closing).append(k)
            seen |= role == "open_next"
        if action == "close_open":
            if not closing:
                closing.append(opening.pop(0))
            if not opening:
                opening.append(closing.pop())
        found.append((b["first"], b["last"], action, items[(opening or closing)[0]][5], b["why"], closing, opening))
        now += closing
        if now:
            made.append(now)
        now = list(opening)
        i = b["last"] + 1
    return found, made + ([now] if now else [])


def test_policies_like_sequential(spark):
    r = random.Random(8)
    held = {s: story(r, s) for s in range(50)}
    df = policies.described(spark.createDataFrame([x for h in held.values() for x in h], ITEM)).repartition(3)
    every = [(p, where) for p in policies.POLICIES for where in policies.PLACEMENTS]
    rows = policies.judged(df, every)
    found, made = {}, {}
    for x in policies.boundaries(rows).orderBy("subject_id", "bundle").collect():
        found.setdefault((x.subject_id, x.policy, x.placement), []).append((x.lo_item, x.hi_item, x.action, x.label, x.reasons, x.closing, x.opening))
    for x in policies.windows(rows, length=10, n_special=1, most=999).orderBy("window").collect():
        made.setdefault((x.subject_id, x.policy, x.placement), []).append(x)
    for s, h in held.items():
        for p, where in every:
            def why(x, p=p):
                text = f"{x[5]} | {'WINDOW_BOUNDARY' if x[6] else ''} | {x[3]}".upper()
                moves = x[3] == "STRUCTURAL" and x[7] in C.ACTIVE
                marks = any(m in text for m in C.MARKER_PARTS)
                out = {"current": [(x[6], "window_hook")], "all_structural": [(x[3] == "STRUCTURAL", "structural_any")], "structural": [(x[3] == "STRUCTURAL", "structural_any")], "gap_only": [], "transition_like": [(moves, "transition_like")], "marker_or_transition": [(moves, "transition_like"), (marks, "marker_like")], "custom_contains": [("ICU" in text, "contains:ICU")]}[p.removesuffix("_plus_gap").removesuffix("_or_gap")]
                if p.endswith("gap") or p == "gap_only":
                    out = [*out, (x[1] > 0 and x[10] >= 6 * H, "gap>=6h")]
                return [n for ok, n in out if ok]

            want, spans = plain(h, why, where)
            key = (s, p, where)
            assert found.get(key, []) == want, key
            got = made[key]
            assert [(x.n_items, x.n_tokens, x.first_label, x.last_label) for x in got] == [(len(k), h[k[-1]][12] - h[k[0]][11] + 1, h[k[0]][5], h[k[-1]][5]) for k in spans], key
            for x, k in zip(got, spans, strict=True):
                typed = [y[8] for y in h if h[k[0]][11] <= y[11] <= h[k[-1]][12] and y[7] in ("open_next", "close_open") and y[8] is not None]
                assert x.type_id == (typed[0] if typed else 0) and x.n_processed == min(x.n_tokens, 7) + 3 and x.truncated == (x.n_tokens > 7)


def test_counters_judge_items_once(spark):
    r = random.Random(6)
    held = {s: story(r, s) for s in range(50)}
    df = policies.described(spark.createDataFrame([x for h in held.values() for x in h], ITEM)).repartition(3)
    rows = policies.judged(df, [(p, where) for p in policies.POLICIES for where in policies.PLACEMENTS])
    out = policies.counters(rows, windows=2, most=1000)
    # windows and boundaries each judged all items before
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    want = Counter()
    for x in policies.windows(rows, most=2).collect():
        for counter, name in (("opening_label", x.first_label), ("closing_label", x.last_label), ("opening_category", x.first_category), ("closing_category", x.last_category), ("window_type", str(x.type_id))):
            want[x.policy, x.placement, counter, name] += 1
    for x in policies.boundaries(rows).collect():
        for counter, name in (("boundary_label", x.label), ("boundary_action", x.action), *(("boundary_reason", y) for y in x.reasons)):
            want[x.policy, x.placement, counter, name] += 1
    assert {k[3] for k in want if k[2] == "boundary_action"} == {"open_next", "close_current", "close_open"}
    assert {(x.policy, x.placement, x.counter, x.name): x.n for x in out.collect()} == want
