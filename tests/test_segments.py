"""Windows, chunks and trajectories against a plain sequential reading of the rules."""

import random

import pytest
from pyspark.sql import functions as F

from caretrail import config as C
from caretrail.operators import segments as S

SCHEMA = "subject_id long, idx long, t_us long, raw_us long, category string, action string, type_id int, site string, adm boolean, tra boolean, dis boolean, dea boolean, icu boolean, orl boolean"
H = S.HOUR_US


def token(idx, t, kind=None, type_id=None, site=None, cat="MEASUREMENT", **flags):
    action = {"open": "open_next", "close": "close_current", "transfer": "close_open"}.get(kind)
    f = {k: bool(flags.get(k)) for k in ("adm", "tra", "dis", "dea", "icu", "orl")}
    f["tra"] = f["tra"] or kind == "transfer"
    f["adm"] = f["adm"] or kind in ("open", "transfer")
    return dict(idx=idx, t_us=int(t * H), raw_us=int(t * H), category="STRUCTURAL" if kind else cat, action=action, type_id=type_id, site=site, **f)


def frame(spark, histories):
    rows = [tuple([s, *(t[c] for c in SCHEMA.replace(",", "").split()[2::2])]) for s, ts in enumerate(histories) for t in ts]
    return spark.createDataFrame(rows, SCHEMA)


def sequential(tokens):
    """Windows of one history: (type, site, indices), by walking through it."""
    cand = [t for t in tokens if t["action"]]
    bundles = []
    for t in cand:
        last = bundles[-1][-1] if bundles else None
        if last and t["idx"] - last["idx"] <= C.BUNDLE_GAP_IDX and abs(t["t_us"] - last["t_us"]) <= C.BUNDLE_GAP_H * H:
            bundles[-1].append(t)
        else:
            bundles.append([t])
    merged = []
    for b in bundles:
        if merged:
            a = merged[-1]
            between = tokens[a[-1]["idx"] + 1 : b[0]["idx"]]
            ok = not any(t["dis"] or t["dea"] for t in b) and not (any(t["dis"] for t in a) and not any(t["dea"] for t in a) and any(t["adm"] for t in b))
            ok = ok and len(between) <= C.CHAIN_TOKENS and not any(t["category"] in C.CLINICAL for t in between) and b[0]["t_us"] - a[-1]["t_us"] <= C.CHAIN_GAP_H * H
            if ok:
                a += b
                continue
        merged.append(list(b))
    out, cur, state, at = [], [], (0, None), 0

    def emit():
        nonlocal cur
        if cur:
            kind = state[0] or (cur[0]["type_id"] or 0)
            site = state[1] or next((t["site"] for t in cur if t["site"]), None)
            out.append((kind, site, [t["idx"] for t in cur]))
        cur = []

    for b in merged:
        lo, hi = b[0]["idx"], b[-1]["idx"]
        cur += tokens[at:lo]
        at = hi + 1
        transfer = [t for t in b if t["tra"]]
        opens = [t for t in b if t["action"] in ("open_next", "close_open")]
        closes = [t for t in b if t["action"] in ("close_current", "close_open")]
        if transfer or (opens and closes):
            pivot = (transfer or opens)[0]["idx"]
        elif opens:
            pivot = lo
        else:
            pivot = None
        if pivot is None:
            cur += tokens[lo : hi + 1]
            emit()
            state = (0 if any(t["dea"] for t in b) or not any(t["dis"] for t in b) else C.WINDOW_TYPES["POST_DISCHARGE"], None)
            continue
        opening = [t for t in b if t["idx"] >= pivot]
        best = min(opening, key=lambda t: (0 if not t["tra"] and (t["icu"] or t["orl"]) else 1 if t["tra"] else 2, t["idx"]))
        kind, site = best["type_id"] or 0, best["site"]
        if cur and kind and kind == state[0] and site and site == state[1]:
            cur += tokens[lo : hi + 1]
            continue
        cur += tokens[lo:pivot]
        emit()
        cur, state = list(tokens[pivot : hi + 1]), (kind, site)
    cur += tokens[at:]
    emit()
    return out


def history(r):
    t, out = 0.0, []
    for i in range(r.randint(1, 60)):
        t += r.choice([0, 0, 0.1, 0.4, 1, 5, 7, 400])
        x = r.random()
        if x < 0.5:
            out.append(token(i, t, cat=r.choice(["MEASUREMENT", "OTHER", "OTHER"])))
        elif x < 0.7:
            k = r.randint(1, 4)
            out.append(token(i, t, "open", k, r.choice(["A", "B", None]), icu=k == 3, orl=k == 4))
        elif x < 0.85:
            out.append(token(i, t, "close", dis=r.random() < 0.7, dea=r.random() < 0.1))
        else:
            k = r.randint(1, 4)
            out.append(token(i, t, "transfer", k, r.choice(["A", "B", "C"]), icu=k == 3, orl=k == 4))
    return out


@pytest.fixture(scope="module")
def histories():
    r = random.Random(5)
    return [history(r) for _ in range(300)]


def test_windows_like_sequential(spark, histories):
    df = frame(spark, histories)
    got = {}
    for r in S.window_tokens(df).orderBy("subject_id", "idx").collect():
        got.setdefault(r.subject_id, {}).setdefault(r.window_ord, []).append(r.idx)
    named = {(r.subject_id, r.window_ord): (r.type_id, r.site) for r in S.windows(df).collect()}
    for s, h in enumerate(histories):
        want = sequential(h)
        assert [got[s][w] for w in sorted(got[s])] == [w[2] for w in want], s
        assert [named[s, i] for i in range(len(want))] == [w[:2] for w in want], s


def test_empty(spark):
    assert S.windows(frame(spark, [])).count() == 0
    assert S.chunks(frame(spark, [])).count() == 0


def test_chunks_cover_and_fit(spark, histories):
    df = frame(spark, histories)
    rows = S.chunks(df, most=8, smallest=2, tail=2).orderBy("subject_id", "window_ord", "chunk_ord").collect()
    total = {(r.subject_id, r.window_ord): r.n_tokens for r in S.windows(df).collect()}
    seen = {}
    for r in rows:
        assert 0 < r.len <= 8 and r.from_pos == seen.get((r.subject_id, r.window_ord), 0)
        seen[r.subject_id, r.window_ord] = r.from_pos + r.len
    assert seen == total


def test_trajectory_cut(spark):
    h = [token(0, 0, "open", 2, "A"), token(1, 10, "close", dis=True), token(2, 40), token(3, 900), token(4, 901, "open", 2, "A"), token(5, 902)]
    rows = S.trajectories(frame(spark, [h])).orderBy("window_ord", "part").collect()
    assert [(r.window_ord, r.part, r.trajectory_ord, r.n_tokens) for r in rows] == [(0, 0, 0, 2), (1, 0, 0, 1), (1, 1, 1, 1), (2, 0, 1, 2)]
    clock = {r.idx: (r.trajectory_ord, r.t_us / H) for r in S.trajectory_clock(frame(spark, [h]).withColumn("dt_us", F.lit(1))).collect()}
    assert clock[2] == (0, 40.0) and clock[3] == (1, 0.0) and clock[5] == (1, 2.0)


def packed(groups, most, target, tail):
    """Chunk sizes by the greedy rule, over (length, break) groups."""
    out, cur, forced = [], 0, False
    for n, brk in groups:
        if cur and (brk or cur + n > most or cur >= target):
            out.append((cur, forced))
            cur, forced = n, brk
        else:
            forced = forced or (brk and cur == 0)
            cur += n
    if out and cur < tail and not forced and out[-1][0] + cur <= most:
        out[-1] = (out[-1][0] + cur, out[-1][1])
    else:
        out.append((cur, forced))
    return [n for n, _ in out]


def test_chunks_like_sequential(spark, histories):
    df = frame(spark, histories)
    rows = S.time_groups(S.window_tokens(df), "window_ord", most=6).orderBy("subject_id", "idx").collect()
    groups = {}
    for r in rows:
        g = groups.setdefault((r.subject_id, r.window_ord), {}).setdefault(r.grp, [0, r.brk])
        g[0] += 1
    got = {}
    for r in S.chunks(df, most=6, smallest=2, fraction=0.5, tail=2).orderBy("subject_id", "window_ord", "chunk_ord").collect():
        got.setdefault((r.subject_id, r.window_ord), []).append(r.len)
    for k, g in groups.items():
        assert got[k] == packed([tuple(g[i]) for i in sorted(g)], 6, 3, 2), k


def test_trajectories_like_sequential(spark, histories):
    df = frame(spark, histories)
    limit, want = int(C.CUTOFF_H * H), {}
    state = {}
    for w in S.windows(df).orderBy("subject_id", "window_ord").collect():
        cut, t = state.get(w.subject_id, (None, 0))
        over = cut is not None and w.start_us > cut
        inside = cut is not None and not over and w.type_id == C.WINDOW_TYPES["POST_DISCHARGE"] and w.end_us > cut
        t += over
        for x in histories[w.subject_id][w.lo : w.hi + 1]:
            want[w.subject_id, x["idx"]] = t + (inside and x["t_us"] > cut)
        own = w.closing_us + limit if w.closing_discharge else None
        state[w.subject_id] = (own if own is not None else None if over or inside else cut, t + inside)
    got = {(r.subject_id, r.idx): r.trajectory_ord for r in S.trajectory_clock(df.withColumn("dt_us", F.lit(1))).collect()}
    assert got == want and max(want.values()) > 1
    assert {r.trajectory_ord for r in S.trajectories(df, mode="full_subject").collect()} == {0}
