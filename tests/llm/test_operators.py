"""Each operator against brute force on small, awkward tables."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from caretrail.llm import bitsliced, exchange, jaccard, licenses, lines, ordering, phrases, pieces, substring, toxicity
from caretrail.llm.base import saved
from caretrail.llm.components import components

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
EXTRA = "doc_id long, text string, n_words long, spans string"


def low(text):
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, 7, "kept") for i, t in enumerate(texts)], EXTRA)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(2, 7))) for _ in range(300)]
    passage = [r.choice(vocabulary) for _ in range(70)]
    out = [None, "", "   \n", "one", "One", "a b c d", "A B c d", "a b c d e"]
    base = [[r.choice(vocabulary) for _ in range(r.randint(30, 160))] for _ in range(40)]
    for b in base:
        out.append(" ".join(b))
        for _ in range(r.randint(0, 4)):
            c = list(b)
            for _ in range(r.randint(0, 6)):
                c[r.randrange(len(c))] = r.choice(vocabulary)
            if r.random() < 0.3:
                k = r.randrange(len(c))
                c[k:k] = passage
            out.append("  ".join(c) if r.random() < 0.5 else "\n".join([" ".join(c[:20]), " ".join(c[20:])]))
        if r.random() < 0.3:
            out.append(out[-1])
    out.append(" ".join(base[0] * 40))
    return out


def groups(texts, pct=80, k=5):
    sets = []
    for t in texts:
        w = SPACE.findall(low(t))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= pct * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("region", [256, 4])
def test_jaccard(spark, corpus, region):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(docs(spark, corpus), region=region, depth=2).collect()}
    assert [got[i] for i in range(len(corpus))] == groups(corpus)


def test_jaccard_odd_rows(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (3, None)], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.component_id) for r in jaccard.jaccard_groups(df).collect()), key=str)
    assert rows == sorted([(1, 1), (1, 1), (2, 1), (None, None), (3, 3)], key=str)
    assert jaccard.jaccard_groups(df.limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (40, 45), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(21), 0), 40: 40, 45: 40, 50: 40}


@pytest.mark.parametrize("period", [31, 13])
def test_substring(spark, corpus, period):
    got = {r.doc_id: r for r in substring.dedup_substrings(docs(spark, corpus), period=period).collect()}
    words = [SPACE.findall((t or "").encode()) for t in corpus]
    first = {}
    for d, w in enumerate(words):
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), d)
    for d, w in enumerate(words):
        cut = [False] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                cut[i : i + 50] = [True] * 50
        assert (got[d].n_words, got[d].n_removed, got[d].kept) == (len(w), sum(cut), b" ".join(x for x, c in zip(w, cut, strict=True) if not c).decode())
    assert substring.dedup_substrings(docs(spark, [])).count() == 0


def test_difference_cover():
    for v in (7, 13, 21, 31):
        c = substring.difference_cover(v)
        assert {(a - b) % v for a in c for b in c} == {*range(v)}


def test_decontamination(spark, corpus):
    items = [(str(i), t) for i, t in enumerate([corpus[8], "one", "", None, " ".join((corpus[9] or "x").split()[:13]).upper(), corpus[8]])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: r for r in phrases.contamination(docs(spark, corpus), bench).collect()}
    windows = {}
    for i, t in items:
        w = WORD.findall(low(t))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
    for d, t in enumerate(corpus):
        w = WORD.findall(low(t))
        hit, who = set(), set()
        for x, ids in windows.items():
            for i in range(len(w) - len(x) + 1):
                if tuple(w[i : i + len(x)]) == x:
                    hit |= {*range(i, i + len(x))}
                    who |= ids
        g = got[d]
        assert (g.n_words, g.n_hit, g["items"], g.contaminated) == (len(w), len(hit), sorted(who), bool(hit) and 20 * len(hit) >= len(w))
    assert not any(r.contaminated for r in phrases.contamination(docs(spark, corpus[:20]), bench.limit(0)).collect())


def test_proximity(spark):
    index = phrases.build_index(docs(spark, ["x b y a z", "a q q q q q b", "b a"]))
    items = spark.createDataFrame([("i", "a b")], "item_id string, text string")
    rows = {(r.doc_id, r.start, r.stop) for r in phrases.find_passages(index, items, window=2, span=3).collect()}
    assert rows == {(0, 1, 4), (2, 0, 2)}


def test_topk(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(0, 0.3, 8)]) for i in range(300)] + [(300 + i, [0.5] * 8) for i in range(30)]
    bad = [(900, None), (901, []), (902, [None] * 8), (903, [float("nan")] * 8), (904, [1.0] * 3)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in bitsliced.search(bitsliced.build_index(df), df.where("vec_id % 50 = 0"), k=10).collect())
    v = np.floor(1024 * np.array([x[1] for x in rows])).astype(int)
    want = []
    for q in range(0, 330, 50):
        s = v @ v[q]
        best = [j for j in np.lexsort((np.arange(len(v)), -s)).tolist() if j != q][:10]
        want += [(q, n + 1, j, int(s[j])) for n, j in enumerate(best)]
    assert got == sorted(want)
    assert bitsliced.search(bitsliced.build_index(df.limit(0)), df.limit(0)).count() == 0


def test_training_order(spark, corpus):
    df = docs(spark, corpus + [corpus[8]]).union(spark.createDataFrame([(None, "x", 1, "")], EXTRA))
    rows = ordering.training_order(df, length=64, slots_per_shard=8).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert all(len(r.payload) == 128 and r.shard == r.slot // 8 for r in rows)
    back = {}
    for r in sorted(rows, key=lambda r: r.seq):
        back[r.doc_id] = back.get(r.doc_id, b"") + bytes((np.frombuffer(r.payload, "<u2")[: r.n_ids] - 1).astype(np.uint8))
    for d, t in enumerate(corpus):
        assert back[d] == (t or "").encode() + b"\xff"
    again = ordering.training_order(df, length=64, slots_per_shard=8).collect()
    assert {(r.doc_id, r.seq, r.slot) for r in rows} == {(r.doc_id, r.seq, r.slot) for r in again}
    for n in (1, 2, 5, 1000):
        assert sorted(ordering.feistel(np.arange(n), n, 3).tolist()) == list(range(n))
    assert ordering.training_order(df.limit(0)).count() == 0


def permuted(x, n, key):
    """The slot of number x among n, with plain integers."""
    half, top = max(1, -(-max(n - 1, 1).bit_length() // 2)), (1 << 64) - 1
    while True:
        left, right = x >> half, x & ((1 << half) - 1)
        for k in ordering._round_keys(key):
            m = (right + k) * 0x9E3779B97F4A7C15 & top
            m = (m ^ m >> 29) * 0xBF58476D1CE4E5B9 & top
            left, right = right, left ^ m >> (64 - half)
        x = left << half | right
        if x < n:
            return x


def test_slots_like_plain_integers(spark, corpus):
    length, want, number = 64, {}, 0
    sizes = [len((t or "").encode()) // length + 1 for t in corpus]
    for d, size in enumerate(sizes):
        for k in range(size):
            want[d, k] = permuted(number, sum(sizes), 17)
            number += 1
    got = {(r.doc_id, r.seq): r.slot for r in ordering.training_order(docs(spark, corpus), length=length).collect()}
    assert got == want


def test_shards_resume(spark, corpus, tmp_path):
    df = docs(spark, corpus).union(spark.createDataFrame([(None, "x", 1, "")], EXTRA))
    order = ordering.training_order(df, length=64, slots_per_shard=8)
    want = {r.slot: (r.doc_id, r.seq, r.n_ids, bytes(r.payload)) for r in order.collect()}
    path, stride = str(tmp_path / "s"), 24 + 128
    for _ in range(2):  # a repeated run leaves the same files
        assert ordering.write_shards(order, path).agg(F.sum("slots")).first()[0] == len(want)
    for s, (_, _, _, payload) in want.items():
        with open(f"{path}/{s // 8}.bin", "rb") as f:
            f.seek(s % 8 * stride + 24)
            assert f.read(128) == payload
    for at in (0, 13, 16, len(want) - 1):
        rows = ordering.read_from(spark, path, at, 8).collect()
        assert [r.slot for r in rows] == list(range(at, len(want)))
        assert all(want[r.slot] == (r.doc_id, r.seq, r.n_ids, bytes(r.payload)) for r in rows)


def test_training_order_of_token_ids(spark):
    rows = [(1, [5, 0, 65534]), (2, None), (3, []), (4, list(range(300)))]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>").withColumn("text", F.lit("x"))
    back = {}
    for r in sorted(ordering.training_order(df, length=16, ids="ids").collect(), key=lambda r: r.seq):
        back.setdefault(r.doc_id, []).extend(np.frombuffer(r.payload, "<u2")[: r.n_ids].tolist())
    assert back == {d: [*(x + 1 for x in ids or []), 0] for d, ids in rows}


def test_topk_with_large_components(spark):
    vectors = [[1e15, 0.5], [-1e15, 0.25], [1e30, 1.0], [-1e30, -1.0], [0.5, 0.5], [1.0, 2.0], [3e9, -3e9]]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    ints = [[max(-(1 << 62), min(1 << 62, int(np.floor(1024 * x)))) for x in v] for v in vectors]
    got = sorted(tuple(r) for r in bitsliced.search(bitsliced.build_index(df), df, k=3).select("query_id", "rank", "vec_id", "score").collect())
    want = []
    for q, a in enumerate(ints):
        score = {j: max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b, strict=True)))) for j, b in enumerate(ints) if j != q}
        want += [(q, n + 1, j, score[j]) for n, j in enumerate(sorted(score, key=lambda j: (-score[j], j))[:3])]
    assert got == want


def test_line_dedup(spark):
    long = "the quick brown fox jumps over lazy hounds near quiet river banks every single morning before breakfast"
    near = long.replace("quiet", "silent")
    texts = [f"{long}\nshort\n{near}", f"Other words stand here in this line\n{long.upper()}", None, "", "short", "Other words  stand here in this line"]
    got = {r.doc_id: r for r in lines.dedup_lines(docs(spark, texts)).collect()}
    assert got[1].text == "Other words stand here in this line" and got[1].n_removed == 1
    assert got[5].text == "" and got[4].text == "short" and got[2].text is None and got[3].text == ""
    assert got[0].text.startswith(f"{long}\nshort")
    assert lines.dedup_lines(docs(spark, [])).count() == 0


def test_line_groups_like_brute_force(spark):
    r = random.Random(9)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(4, 9))) for _ in range(400)]
    texts = []
    for _ in range(40):
        w = [r.choice(vocabulary) for _ in range(30)]
        for _ in range(5):
            c = list(w)
            for _ in range(r.randint(0, 3)):
                c[r.randrange(30)] = r.choice(vocabulary)
            texts.append(" ".join(c))
    got = {x.doc_id: bool(x.n_removed) for x in lines.dedup_lines(docs(spark, texts)).collect()}
    from caretrail.llm.base import NOT_SPACE, Words

    raw = [t.encode() for t in texts]
    sims = lines.simhashes(Words(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])], NOT_SPACE, False))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if bin(int(sims[i]) ^ int(sims[j])).count("1") <= lines.NEAR and lines.alike(texts[i], texts[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert [got[i] for i in range(len(texts))] == [find(i) != i for i in range(len(texts))]


def test_short_lines_that_repeat_exactly(spark):
    texts = ["short line\none\nshort  LINE", "one\n中文没有空格的一行", "中文没有空格的一行\nshort lines\n\n"]
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.dedup_lines(docs(spark, texts), near=None, short=True).collect()}
    assert got == {0: ("short line\none", 1), 1: ("中文没有空格的一行", 1), 2: ("short lines\n\n", 1)}


@pytest.mark.parametrize(("small", "pivots", "block", "others", "kinds"), [(64, 4, 2048, 512, 300), (2, 4, 2048, 512, 300), (2, 1, 4, 2, 6)])
def test_near_lines_by_edit_distance_alone(spark, monkeypatch, small, pivots, block, others, kinds):
    for name, value in (("SMALL", small), ("PIVOTS", pivots), ("BLOCK", block), ("OTHERS", others)):
        monkeypatch.setattr(lines, name, value)
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(kinds)]
    texts = []
    for n in [5, 6, 9, 10, 14, 15, 16, 18, 19, 20, 24, 25, 40, 60] * 3:
        w = [r.choice(vocabulary) for _ in range(n)]
        for _ in range(5):
            c = list(w)
            for _ in range(r.randint(0, n // 5 + 1)):
                k = r.randrange(len(c))
                c[k : k + r.randint(0, 1)] = [r.choice(vocabulary) for _ in range(r.randint(0, 1))]
            texts.append(" ".join(c))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if min(len(texts[i].split()), len(texts[j].split())) >= 5 and lines.alike(texts[i], texts[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {x.doc_id: bool(x.n_removed) for x in lines.dedup_lines(docs(spark, texts), near=None).collect()}
    assert [got[i] for i in range(len(texts))] == [find(i) != i for i in range(len(texts))]


def test_long_lines_are_candidates_only_if_their_words_agree(spark):
    r = random.Random(5)
    line = lambda n, frequent: [f"{frequent}{int(r.paretovariate(0.6))}" for _ in range(n)]
    texts = []
    for n in (130, 400, 1500):
        w = line(n, "a")
        c = list(w)
        for _ in range(n // 5):
            k = r.randrange(len(c))
            c[k : k + r.randint(0, 1)] = [f"x{r.random()}" for _ in range(r.randint(0, 1))]
        texts += [w, c, line(n, "b")]
    table = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "h long, norm string")
    rows = spark.createDataFrame([(i // 3, False, i, 0, len(x) << lines.SKETCH, i, 3, True) for i, x in enumerate(texts)], "key long, two boolean, h long, sim long, tag long, comp long, m long, minor boolean")
    got = {tuple(x) for x in lines._met(rows.join(lines.wide(table), "h"), lines.BITS, 80).collect()}
    near = {(i, j) for i in range(9) for j in range(i + 1, 9) if i // 3 == j // 3 and lines.alike(" ".join(texts[i]), " ".join(texts[j]))}
    # the parities of 256 classes alone let all pairs of the 400 and 1500 words pass
    assert got == near and len(near) == 3


def test_near_long_lines_among_many(spark, monkeypatch):
    for name, value in (("SMALL", 2), ("PIVOTS", 1), ("BLOCK", 4), ("OTHERS", 2), ("LONG", 12)):
        monkeypatch.setattr(lines, name, value)
    r = random.Random(3)
    texts = []
    for n in [10, 12, 13, 15, 20, 40, 70] * 3:
        w = [r.choice("abcdef") * 3 for _ in range(n)]
        for _ in range(4):
            c = list(w)
            for _ in range(r.randint(0, n // 5 + 1)):
                k = r.randrange(len(c))
                c[k : k + r.randint(0, 1)] = [r.choice("abcdef") * 3 for _ in range(r.randint(0, 1))]
            texts.append(" ".join(c))
    first = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if lines.alike(texts[i], texts[j]) and first[i] != first[j]:
                low, high = sorted((first[i], first[j]))
                first = [low if x == high else x for x in first]
    got = {x.doc_id: bool(x.n_removed) for x in lines.dedup_lines(docs(spark, texts), near=None).collect()}
    assert [got[i] for i in range(len(texts))] == [first[i] != i for i in range(len(texts))]


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {n for n in names if n.startswith("shuffle_")}


def test_scratch_tables_leave_no_shuffle_files(spark):
    """They stayed until the driver's collector came, and were most of the disk that lines took."""
    before = _shuffle_files(spark)
    held = [saved(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), "held")]
    held.append(components(spark.range(50).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))))
    end = time.time() + 20
    while (left := _shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.2)
    assert not left
    assert held[0].count() == 7 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


@pytest.mark.parametrize("later", [False, True])
def test_meeting_of_keys_in_ranges(spark, monkeypatch, later):
    monkeypatch.setattr(exchange, "ROWS", 200)
    monkeypatch.setattr(exchange, "SETTLED", 16)
    r = random.Random(8)
    rows = [(r.choice([-(1 << 62), -5, 0, 3, (1 << 62) + 1, r.randrange(-300, 300)]), r.randrange(40), i) for i in range(3000)]

    def emit(batch):
        yield tuple(c.to_numpy() for c in batch.columns)

    df = spark.createDataFrame(rows, "k long, o long, t long").repartition(5)
    got = sorted((x.key, x.owner, x.tag) for x in exchange.meet(df, emit, later).collect())
    owners = {}
    for k, o, _ in rows:
        owners.setdefault(k, set()).add(o)
    want = {x for x in rows if (x[1] > min(owners[x[0]]) if later else len(owners[x[0]]) > 1)}
    assert got == sorted(want)


def test_edit_distance():
    r = random.Random(2)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 9))] for _ in range(2))
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            d2 = [i]
            for j, y in enumerate(b, 1):
                d2.append(min(d[j] + 1, d2[-1] + 1, d[j - 1] + (x != y)))
            d = d2
        assert lines.edit_distance(a, b, 4) == min(d[-1], 5)


ODD = ["", None, " ", "  a", "a  ", "▁▁x y ▁ z", "<s></s><0x0A> x\x00\n\t\r é𓀀 ", "x" * 900 + " " * 70 + "y", "Größe naïve 中文字 12345", "e" * 3000]


def test_pieces_like_library(spark, corpus):
    m = pieces.model(pieces._path("piece_bpe_32k.model"))
    texts = corpus + ODD
    rows = {r.doc_id: r for r in pieces.encode(docs(spark, texts), "piece_bpe_32k.model", ids=True).collect()}
    counts = {r.doc_id: r for r in pieces.count_tokens(docs(spark, texts), "piece_bpe_32k.model", limit=50).collect()}
    for i, t in enumerate(texts):
        want = m.library.encode(t or "") + [m.end]
        assert rows[i].ids == want and rows[i].n_tokens == len(want) and rows[i].decoded == m.library.decode(want) and rows[i].n_repaired == 0
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert (counts[i].n_tokens, counts[i].n_bytes, counts[i].over_limit) == (len(want) - 1, len((t or "").encode()), len(want) - 1 > 50)


def test_license_scan(spark):
    filler = " ".join(f"word{i} filling" for i in range(40))
    texts = [None, "", "Released under the MIT License.", f"{filler} Licensed under the Apache License, Version 2.0. {filler}", f"licensed software {filler}", "Licensed under CC BY-NC 4.0.", f"{filler}\nThis work is LICENSED under the GNU General Public License, version 3."]
    got = {(r.doc_id, r.license) for r in licenses.scan(docs(spark, texts)).collect()}
    assert got == {(2, "MIT"), (3, "Apache-2.0"), (5, "CC-BY-NC-4.0"), (6, "GPL-3.0")}
    plan = licenses.scan(docs(spark, texts))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_each_license_template_and_short_ones(spark):
    filler = " ".join(f"word{i} filling" for i in range(40))
    names = sorted(licenses.TEMPLATES)
    texts = [x for n in names for x in (licenses.TEMPLATES[n] + ".", f"{filler}\n{licenses.TEMPLATES[n].upper()} {filler}")]
    got = {(r.doc_id, r.license) for r in licenses.scan(docs(spark, texts)).collect()}
    assert "All-rights-reserved" in names and got == {(i, names[i // 2]) for i in range(len(texts))}
    own = {"spdx": "SPDX-License-Identifier: X11", "one": "unlicensed", "long": "one two three four five six seven"}
    texts = ["unlicensed", f"{filler} SPDX-License-Identifier: X11", "spdx license", "all rights", f"one two three four five six seven {filler}", ""]
    got = {(r.doc_id, r.license, r.found, r.total) for r in licenses.scan(docs(spark, texts), own).collect()}
    assert got == {(0, "one", 1, 1), (1, "spdx", 1, 1), (4, "long", 3, 3)}
    with pytest.raises(ValueError):
        licenses.scan(docs(spark, texts), {"none": "..."})


def test_license_bands_suffice_for_short_templates(spark):
    assert licenses._needed(1, 5, 5, 80) >= 107 and (5 / 6) ** licenses._needed(1, 5, 5, 80) <= licenses.MISS
    # one band alone would miss most of these windows
    texts = [f"a{i} b{i} c{i} d{i} e{i} released under the mit license f{i} g{i} h{i} i{i} j{i}" for i in range(200)]
    assert licenses.scan(docs(spark, texts), {"MIT": licenses.TEMPLATES["MIT"]}, bands=1).count() == 200


def test_marginals_like_brute_force():
    r = np.random.default_rng(4)
    unary, first, step = r.normal(0, 2, 9), np.array([0, 4, 4, 9]), r.normal(0, 1, (2, 2))
    got, pairs = toxicity.marginals(unary, first, step, pairs=True)
    total = np.zeros((2, 2))
    for a, b in ((0, 4), (4, 9)):
        n = b - a
        weight, p, pair = 0.0, np.zeros(n), np.zeros((2, 2))
        for bits in range(1 << n):
            y = [bits >> i & 1 for i in range(n)]
            w = np.exp(sum(unary[a + i] * y[i] for i in range(n)) + sum(step[y[i], y[i + 1]] for i in range(n - 1)))
            weight += w
            p += w * np.array(y)
            for i in range(n - 1):
                pair[y[i], y[i + 1]] += w
        assert np.allclose(got[a:b], p / weight)
        total += pair / weight
    assert np.allclose(pairs, total)


def test_toxicity(spark):
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(200)]
    rows, labels = [], []
    for i in range(400):
        w = [r.choice(vocabulary) for _ in range(r.randint(5, 60))]
        bad = i % 4 == 0
        if bad:
            w[r.randrange(len(w))] = "zyxxy" + r.choice(["", "er", "ing"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    df, marks = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    field = toxicity.train(df, marks)
    got = {x.doc_id: x for x in toxicity.score(df.withColumn("score", F.lit("clash")), field).collect()}
    assert sum(got[i].predicted == t for i, t in labels) >= 396
    assert got[900].predicted == got[901].predicted == 0 and got[900].spans == []
    hit = got[0]
    assert any("zyxxy" in rows[0][1].encode()[a:b].decode() for a, b in zip(hit.spans[::2], hit.spans[1::2], strict=True))
    assert toxicity.train(df, marks.limit(0)) is None
    assert {x.score for x in toxicity.score(df, None).collect()} == {0.0}


CLASH = "doc_id long, text string, gone string, score string, x long, p long, s long, n long, k long, m long, part string, component long, slot long, found long, tokens string, _id long"


@pytest.mark.parametrize("rows", [[], [(None,) * 16], [(1, None, *[None] * 14), (1, None, *[None] * 14), (2, "a b c d e f", "g", "s", *[1] * 6, "p", 1, 1, 1, "t", 1)]])
def test_odd_tables(spark, rows):
    df = spark.createDataFrame(rows, CLASH)
    bench = spark.createDataFrame([(None, None), ("1", "a b c d e f")], "item_id string, text string")
    marks = spark.createDataFrame([(None, None), (2, 1)], "doc_id long, toxic int")
    n = len(rows)
    assert jaccard.jaccard_groups(df).count() == n
    assert substring.dedup_substrings(df).count() == n
    assert phrases.contamination(df, bench).count() == n
    assert lines.dedup_lines(df).count() == n
    assert pieces.encode(df, "piece_bpe_32k.model").count() == n
    assert pieces.count_tokens(df, "piece_bpe_32k.model").count() == n
    assert ordering.training_order(df).count() == n
    assert licenses.scan(df).count() == 0
    assert toxicity.score(df, toxicity.train(df, marks)).count() == n
    vectors = df.select(F.col("doc_id").alias("vec_id"), F.lit(None).cast("array<float>").alias("embedding"), "score")
    assert bitsliced.search(bitsliced.build_index(vectors), vectors).count() == 0


def test_very_long_text(spark):
    words = [f"w{i % 5003}" for i in range(400_000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:200_000])), (3, "x" * 3_000_000), (4, " ".join([*words, "more"]))], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(df).collect()}
    assert got == {1: (5003, 1), 2: (5003, 1), 3: (1, 3), 4: (5004, 1)}
    gone = {r.doc_id: (r.n_words, r.n_removed) for r in substring.dedup_substrings(df).collect()}
    assert gone == {1: (400_000, 0), 2: (200_000, 200_000), 3: (1, 0), 4: (400_001, 400_000)}
