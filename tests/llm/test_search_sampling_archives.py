"""Lexical search, importance resampling and archives against plain readings."""

import base64
import gzip
import hashlib
import io
import math
import random
import re
import zlib

import numpy as np
import pytest

from caretrail.llm import importance, lexical, warc

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CLASH = "doc_id long, text string, score string, rank long, weight string, n long, q long, bound string, block long, salt int, start long, nth long"


def terms(text):
    return TERM.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def wide(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 10) for r in rows], CLASH)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdeéß字Q") for _ in range(r.randint(1, 6))) for _ in range(150)] + ["x" * 40, "Lang" * 30]
    out = [None, "", " -- ", "one", "One one", "字"]
    for _ in range(400):
        out.append(" ,".join(r.choice(vocabulary) for _ in range(min(300, int(r.expovariate(0.03)) + 1))))
    out += [out[20]] * 30 + [" ".join(r.choice(vocabulary) for _ in range(20_000))]
    return out


# --- lexical search ---------------------------------------------------------------


def ranked(docs, items, k=10):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n, total = len(held), sum(len(w) for _, w in held)
    df, counts = {}, []
    for _, w in held:
        c = {}
        for t in w:
            c[t] = c.get(t, 0) + 1
        counts.append(c)
        for t in c:
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for (i, w), c in zip(held, counts, strict=True):
            m = 25 + 75 * len(w) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("docs_in_block", [1, 7, 64])
def test_search_is_exact(spark, texts, monkeypatch, docs_in_block):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", docs_in_block)
    rows = [(i * 3 - 50, t) for i, t in enumerate(texts)]
    items = [(1, texts[30]), (2, "One 字 nowhere"), (3, None), (4, ""), (5, "nowhere"), (6, texts[20]), (7, " ".join(texts[40:60])), (8, texts[-1])]
    index = lexical.build_index(wide(spark, rows).repartition(3))
    got = lexical.search(index, wide(spark, items).withColumnRenamed("doc_id", "item_id"), k=10)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect())) == ranked(rows, items)


def test_search_prunes_blocks(spark, monkeypatch):
    """A rare term's blocks are scored, others not."""
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 4)
    docs = spark.createDataFrame([(i, "common filler " * 5 + ("rare" if i % 100 == 7 else "")) for i in range(2000)], "doc_id long, text string").coalesce(1)
    index = lexical.build_index(docs)
    queries = lexical._Queries(["common rare"])
    queries.weigh(lexical._holders(index, queries), index.documents)
    least = lexical._thresholds(index, queries, 2)
    bounds = [int(queries.bounds(*queries.among(np.frombuffer(r.terms, np.uint64)), np.frombuffer(r.peaks, np.int32))[0]) for r in index.blocks.collect()]
    assert 1 < sum(b >= least[0] for b in bounds) <= 20 < len(bounds)


def test_search_in_query_blocks(spark, texts, monkeypatch):
    monkeypatch.setattr(lexical, "QUERY_BYTES", 500)
    rows = [(i, t) for i, t in enumerate(texts[:150])]
    items = [(i, t) for i, t in enumerate(texts[6:40])]
    got = lexical.search(lexical.build_index(wide(spark, rows)), spark.createDataFrame(items, "item_id int, text string"), k=3)
    assert sorted(map(tuple, got.collect())) == ranked(rows, items, 3)
    assert dict(got.dtypes)["item_id"] == "int"


def test_search_odd_tables(spark):
    none = wide(spark, [])
    items = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a")], "item_id long, text string")
    assert lexical.search(lexical.build_index(none), items).collect() == []
    docs = wide(spark, [(None, "a b"), (1, "a b"), (1, "a b"), (2, None), (3, "c"), (4, "c"), (5, "c")])
    got = lexical.search(lexical.build_index(docs), items).collect()
    assert sorted((str(r.item_id), r.rank, str(r.doc_id)) for r in got) == [("1", 1, "None"), ("1", 2, "1"), ("1", 3, "1"), ("None", 1, "None"), ("None", 2, "1"), ("None", 3, "1")]
    assert lexical.search(lexical.build_index(docs), items.limit(0)).collect() == []


# --- importance resampling ----------------------------------------------------------


def resampled(docs, target, percent, least, key, buckets):
    def features(text):
        w = terms(text)
        return [zlib.crc32(b" ".join(w[i : i + k])) % buckets for k in (1, 2) for i in range(len(w) - k + 1)]

    s, t = [0] * buckets, [0] * buckets
    for _, x in docs:
        for b in features(x):
            s[b] += 1
    for x in target:
        for b in features(x):
            t[b] += 1
    gain = [math.floor(1000 * math.log((a + 1) * (sum(s) + buckets) / ((b + 1) * (sum(t) + buckets)))) for a, b in zip(t, s, strict=True)]
    out, may = [], []
    for i, x in docs:
        f = features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{key}:{i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None])
        if len(terms(x)) >= least:
            may.append(out[-1])
    may.sort(key=lambda r: (-r[3], r[0]))
    for rank, row in enumerate(may[: len(may) * percent // 100], 1):
        row[4] = rank
    return sorted(map(tuple, out))


@pytest.mark.parametrize("percent, least, at_once", [(25, 20, 1 << 18), (60, 0, 37), (0, 5, 1), (100, 1, 1000)])
def test_resampling(spark, texts, monkeypatch, percent, least, at_once):
    monkeypatch.setattr(importance, "AT_ONCE", at_once)
    docs = [(i, t) for i, t in enumerate(texts[: None if at_once > 1 else 60])]
    target = [*texts[8:15], None, ""]
    got = importance.resample(wide(spark, docs).repartition(3), spark.createDataFrame([(t,) for t in target], "text string"), 2, 500, percent, least, 7)
    assert sorted(map(tuple, got.select("doc_id", "n_features", "weight", "score", "rank").collect())) == resampled(docs, target, percent, least, 7, 500)


def test_crc_algebra():
    r = random.Random(5)
    words = [bytes(r.randrange(256) for _ in range(r.choice([0, 1, 3, 31, 32, 33, 64, 100, 5000]))) for _ in range(500)]
    end = np.cumsum([len(w) for w in words])
    start = end - np.array([len(w) for w in words])
    crc = importance.word_crcs(np.frombuffer(b"".join(words), np.uint8), start, end)
    assert crc.tolist() == [zlib.crc32(w) for w in words]
    assert importance.joined(crc[:-1], crc[1:], (end - start)[1:]).tolist() == [zlib.crc32(a + b) for a, b in zip(words, words[1:])]


def test_resampling_longer_runs(spark):
    got = {r.bucket: r.n for r in importance.bucket_counts(spark.createDataFrame([("a Bb a bb c",), (None,), ("a",)], "text string"), 3, 1 << 30).collect()}
    want = {}
    for w in (["a", "bb", "a", "bb", "c"], ["a"]):
        for k in (1, 2, 3):
            for i in range(len(w) - k + 1):
                b = zlib.crc32(" ".join(w[i : i + k]).encode()) % (1 << 30)
                want[b] = want.get(b, 0) + 1
    assert got == want


def test_resampling_odd_tables(spark):
    target = spark.createDataFrame([("a b",)], "text string")
    assert importance.resample(wide(spark, []), target).count() == 0
    long = " ".join(f"w{i % 997}" for i in range(300_000))
    rows = [(None, "a b"), (None, "a b"), (5, None), (5, "a b"), (7, long), (8, "x" * 2_000_000)]
    got = importance.resample(wide(spark, rows), target.limit(0), percent=50, least_words=1).collect()
    assert len(got) == 6 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2]
    assert {r.n_features for r in got if r.doc_id == 7} == {599_999} and {r.n_features for r in got if r.doc_id == 8} == {1}
    assert [r.score - r.weight for r in got if r.doc_id == 5] == [[r.score for r in got if r.doc_id == 5 and not r.n_features][0]] * 2


# --- archives -------------------------------------------------------------------------


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def expected(rows, least=0):
    data = [(i, (t or "").encode()) for i, t in rows]
    top = {}
    for i, b in data:
        top[b] = max(top.get(b, i), i)
    out = []
    for i, b in data:
        again = len(b) >= least and i != top[b]
        out.append((i, len(b), b32(b), "revisit" if again else "response", top[b] if again else None, None))
    return sorted(out, key=str)


PAGES = "page_id long, url string, html string, digest string, top long, payload string, salt int, record_type string"


@pytest.fixture(scope="module")
def pages():
    r = random.Random(2)
    out = [(0, None, None), (1, "http://a/ b\r\nX: 1", ""), (2, "http://é", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (3, "u", "0\r\n\r\n"), (4, "u", "\n"), (9, "u", "字" * 70_000)]
    for i in range(10, 150):
        out.append((i, f"http://h/{i}", "".join(r.choice("ab\r\n\t字é<>") for _ in range(int(r.expovariate(0.002))))))
    return out + [(i, "copy", out[20][2]) for i in range(200, 260)] + [(300, "copy", out[5][2])]


@pytest.mark.parametrize("segment, chunk, least", [(1 << 20, 8192, 0), (100, 7, 0), (1000, 1 << 20, 200), (64, 1, 1)])
def test_archives_round_trip(spark, pages, segment, chunk, least):
    rows = pages if chunk > 1 else [p for p in pages if len(p[2] or "") < 2000]
    df = spark.createDataFrame([(*p, *[None] * 5) for p in rows], PAGES).repartition(3)
    got = warc.round_trip(df, least, segment, chunk)
    assert sorted(map(tuple, got.collect()), key=str) == expected([(i, t) for i, _, t in rows], least)


def test_archives_hold_true_records(spark, pages, tmp_path):
    path = str(tmp_path / "w")
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string"), path, segment_bytes=500, chunk_bytes=300)
    kinds, numbers = {}, 0
    for f in (tmp_path / "w").glob("part-*"):
        for fields, block in warc.parse(warc.opened(f.read_bytes())):
            kinds[fields["warc-type"]] = kinds.get(fields["warc-type"], 0) + 1
            assert len(block) == int(fields["content-length"]) <= 500
            numbers += "warc-segment-number" in fields
            assert ("warc-segment-origin-id" in fields) == (fields["warc-type"] == "continuation")
    assert kinds["revisit"] == 62 and kinds["continuation"] > 100 and numbers > kinds["continuation"]
    html = {p[0]: (p[2] or "").encode() for p in pages}
    for r in warc.read(spark, path).where("type = 'response'").collect():
        assert bytes(r.payload) == html[int(r.record_id.split(":")[2])] and r.problem is None


def test_archives_empty_and_repeated(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(none).count() == 0
    big = "q" * 5000
    rows = [(None, None, "a"), (None, None, "b"), (1, None, "a"), (1, None, "a"), (2, None, big), (2, None, big), (3, None, big)]
    got = sorted(map(tuple, warc.round_trip(spark.createDataFrame(rows, none.schema), segment_bytes=512).collect()), key=str)
    digest = {t: b32(t.encode()) for t in ("a", "b", big)}
    want = [(None, 1, digest["a"], "revisit", 1), (None, 1, digest["b"], "response", None), (1, 1, digest["a"], "response", None), (1, 1, digest["a"], "response", None)]
    want += [(2, 5000, digest[big], "revisit", 3)] * 2 + [(3, 5000, digest[big], "response", None)]
    assert got == sorted(((*w, None) for w in want), key=str)
    again = [(3, None, big), (3, None, big)]
    got = warc.round_trip(spark.createDataFrame(again, none.schema), segment_bytes=512).collect()
    assert [tuple(r) for r in got] == [(3, 5000, digest[big], "response", None, None)] * 2


def record(fields, block):
    return ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + f"Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_reading_other_archives(spark, tmp_path):
    """Segments over several archives and members, plain and gzipped; broken records."""
    http = b"HTTP/1.1 200 OK\r\nTRANSFER-ENCODING: Chunked\r\n\r\n4;x=1\r\nWiki\r\nA\r\npedia in\r\n\r\n0\r\nTrailer: t\r\n\r\n"
    named = lambda k, i, **more: {"WARC-Type": k, "WARC-Record-ID": f"<{i}>", **{x.replace("_", "-"): v for x, v in more.items()}}
    one = record(named("warcinfo", "info"), b"software: x\r\n") + record(named("continuation", "a3", WARC_Segment_Origin_ID="<a>", WARC_Segment_Number=3, WARC_Segment_Total_Length=len(http)), http[70:])
    two = record(named("response", "a", WARC_Segment_Number=1), http[:30]) + record(named("response", "b", WARC_Segment_Number=1), http[:30])
    three = record(named("continuation", "a2", WARC_Segment_Origin_ID="<a>", WARC_Segment_Number=2), http[30:70]) + record(named("continuation", "b3", WARC_Segment_Origin_ID="<b>", WARC_Segment_Number=3, WARC_Segment_Total_Length=30), b"")
    three += record(named("continuation", "c2", WARC_Segment_Origin_ID="<c>", WARC_Segment_Number=2, WARC_Segment_Total_Length=3), b"abc")
    four = record(named("response", "d"), b"HTTP/1.0 200 OK\r\nContent-Length: 3\r\n\r\nabcdef") + record(named("response", "e"), b"HTTP/1.0 200 OK\r\nContent-Length: 9\r\n\r\nabc") + record(named("response", "f"), b"no header")
    four += record(named("response", "g"), b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n9\r\nabc\r\n0\r\n\r\n") + record(named("resource", "h", WARC_Payload_Digest="sha1:" + b32(b"body")), b"body")
    four += record(named("resource", "i", WARC_Payload_Digest="sha1:" + b32(b"other")), b"body") + record(named("response", "j"), b"HTTP/1.1 200 OK\n\nto the end")
    four += record(named("resource", "k"), b"whole text")[:-8]
    files = {"1.warc.gz": gzip.compress(one[:40]) + gzip.compress(one[40:]), "2.warc": two, "3.warc.gz": gzip.compress(three), "4.warc": four}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.record_id or "none": (bytes(r.payload) if r.payload is not None else None, r.problem) for r in warc.read(spark, str(tmp_path)).collect()}
    assert got == {
        "<a>": (b"Wikipedia in\r\n", None),
        "<b>": (None, "segments"), "none": (None, "segments"), "<d>": (b"abc", None), "<e>": (None, "length"), "<f>": (None, "header"),
        "<g>": (None, "framing"), "<h>": (b"body", None), "<i>": (None, "digest"), "<j>": (b"to the end", None), "<k>": (None, "truncated"),
    }


def test_chunked_framing():
    assert warc.unchunked(b"4\r\nWiki\r\n5;n=v\r\npedia\r\n0\r\nA: b\r\n\r\n") == b"Wikipedia"
    assert warc.unchunked(b"a\n0123456789\n0\n\n") == b"0123456789"
    for broken in (b"", b"4\r\nWiki\r\n", b"4\r\nWik", b"zz\r\n", b"4\r\nWikiX0\r\n\r\n", b"-1\r\n\r\n"):
        assert warc.unchunked(broken) is None
    assert warc.unchunked(warc._chunked(b"x" * 1000, 7)) == b"x" * 1000
    assert list(warc.parse(io.BytesIO(b""))) == []
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(b"junk")))
