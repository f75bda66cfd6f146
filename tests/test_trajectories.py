"""Specials as known at each trajectory's anchor, against a plain reading."""

import random

from caretrail.operators import trajectories

EVENT = "subject_id long, pos long, t_us long, code string, numeric_value double"
YEAR = 31_557_600_000_000


def plain(events, anchor):
    sex = next((c[-1] == "M" for _, c, _ in events if c in ("GENDER//M", "GENDER//F")), False)
    born = next((t for t, c, _ in events if c == "MEDS_BIRTH" and t is not None), None)
    last = {}
    for t, c, v in events:
        if t is not None and t <= anchor and v is not None and c in ("BMI (kg/m2)", "Weight (Lbs)", "Height (Inches)"):
            if c not in last or t >= last[c][0]:
                last[c] = (t, v)
    kg, cm = (last[c][1] * f if c in last else None for c, f in (("Weight (Lbs)", 0.45359237), ("Height (Inches)", 2.54)))
    bmi = last["BMI (kg/m2)"][1] if "BMI (kg/m2)" in last else kg / (cm / 100) ** 2 if kg is not None and cm else None
    out = [(31 if sex else 30, None)]
    if born is not None and anchor >= born:
        out.append((32 + sum((anchor - born) / YEAR >= x for x in (18, 40, 65, 80)), None))
    if bmi is not None and bmi > 0:
        out.append((37 + sum(bmi >= x for x in (18.5, 25, 30, 35, 40)), None))
    return out + [(i, v) for i, v in ((43, cm), (44, kg)) if v is not None and v > 0]


def test_specials_as_of_each_anchor(spark):
    r = random.Random(6)
    held, anchors = {}, []
    for s in range(40):
        now, rows = 50 * YEAR, []
        if r.random() < 0.7:
            rows.append((r.randint(0, 50) * YEAR, "MEDS_BIRTH", None))
        if r.random() < 0.7:
            rows.append((None, r.choice(["GENDER//M", "GENDER//F"]), None))
        for _ in range(r.randint(0, 12)):
            now += r.choice([0, 1, 5])
            rows.append((now, r.choice(["BMI (kg/m2)", "Weight (Lbs)", "Height (Inches)", "LAB//1"]), r.choice([None, 0.0, 20.0, 33.0, 70.0, 170.0])))
        held[s] = rows
        anchors += [(s, k, 50 * YEAR + r.randint(0, 30)) for k in range(4)]
    df = spark.createDataFrame([(s, i, *x) for s, rows in held.items() for i, x in enumerate(rows)], EVENT).repartition(3)
    got = {}
    for x in trajectories.specials(df, spark.createDataFrame(anchors, "subject_id long, trajectory_ord int, anchor_us long")).orderBy("ord").collect():
        got.setdefault((x.subject_id, x.trajectory_ord), []).append((x.token_id, None if x.value is None else round(x.value, 9)))
    for s, k, at in anchors:
        assert got[(s, k)] == [(i, None if v is None else round(v, 9)) for i, v in plain(held[s], at)], (s, k)
