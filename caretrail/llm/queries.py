"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitsliced, importance, jaccard, lexical, licenses, lines, ordering, phrases, pieces, substring, toxicity, warc
from .base import table

VOCABULARY = "piece_bpe_32k.model"


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"), k=5, threshold_pct=80)


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.training_order(table(spark, sf_dir, "documents"), length=2048, key=17)


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return bitsliced.search(bitsliced.build_index(vectors), vectors.where("vec_id % 100 = 0"), k=10)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = phrases.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13, percent=5)
    joined = pieces.sha256(F.array_join("items", ","))
    return out.select("doc_id", "n_words", "n_hit", "n_items", joined.alias("items_sha256"), "contaminated")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup_substrings(table(spark, sf_dir, "documents"), window=50)
    return out.select("doc_id", "n_words", "n_removed", pieces.sha256(F.col("kept")).alias("kept_sha256"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), near=None, short=True)
    return out.select("doc_id", "n_lines", "n_removed", pieces.sha256(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pieces.encode(docs, VOCABULARY)
    return out.select("doc_id", "n_tokens", "ids_sha256", pieces.sha256(F.col("decoded")).alias("decoded_sha256"), "n_repaired")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.count_tokens(docs, VOCABULARY, limit=4096)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "spans")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), k=10)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=2, buckets=10_000, percent=25, least_words=20, key=7)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), least_bytes=0, segment_bytes=8192, chunk_bytes=4096).drop("problem")


QUERIES = {"op1_ngram_jaccard": op1_ngram_jaccard, "op2_training_order": op2_training_order, "op3_topk": op3_topk, "op4_decontamination": op4_decontamination, "op5_substring_dedup": op5_substring_dedup, "op6_line_dedup": op6_line_dedup, "op7_pieces": op7_pieces, "op8_token_counts": op8_token_counts, "op9_licenses": op9_licenses, "op10_toxicity": op10_toxicity, "op11_lexical": op11_lexical, "op12_importance": op12_importance, "op13_warc": op13_warc}
#: Words of a text in SQL: runs outside a class of characters, A-Z in lower case or not.
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = "list_filter(string_split_regex({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_WORDS = "list_filter(string_split_regex({}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": f"""with recursive d as (select doc_id, {_SPACED.format(_LOW)} as w from documents),
 s as (select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i:i + 4], ' ') end as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from d where len(w) > 0)),
 n as (select doc_id, count(*) as n from s group by 1),
 p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
 l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
 e as (select a, b from l union all select b, a from l),
 r(doc_id, c) as (select doc_id, doc_id from d union select e.b, r.c from r join e on e.a = r.doc_id)
 select d.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(r.c) as component_id from d join r using (doc_id) left join n using (doc_id) group by 1""",
    "op3_topk": """with e as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 s as (select q.vec_id as query_id, e.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * e.v[i]))::bigint as score from e q join e on q.vec_id <> e.vec_id and len(q.v) = len(e.v) where q.vec_id % 100 = 0)
 select query_id, rank, vec_id, score from (select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from s) where rank <= 10""",
    "op4_decontamination": f"""with d as (select doc_id, {_WORDS.format(_LOW)} as w from documents), b as (select cast(item_id as varchar) as item_id, {_WORDS.format(_LOW)} as w from benchmark),
 q as (select distinct item_id, array_to_string(w[i:i + 12], ' ') as s, least(len(w), 13) as n from (select item_id, w, unnest(range(1, greatest(len(w) - 11, 2))) as i from b where len(w) > 0)),
 z as (select distinct n from q),
 o as (select doc_id, i, z.n, array_to_string(w[i:i + z.n - 1], ' ') as s from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d) x, z where i + z.n - 1 <= len(w)),
 m as (select doc_id, i, o.n, item_id from o join q using (s, n)),
 h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from m) group by 1),
 t as (select doc_id, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct item_id)), ',') as items from m group by 1)
 select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit > 0 and 20 * n_hit >= len(w), false) as contaminated
 from d left join h using (doc_id) left join t using (doc_id)""",
    "op5_substring_dedup": f"""with d as (select doc_id, {_SPACED.format("coalesce(text, '')")} as w from documents),
 x as (select doc_id, i, hash(w[i:i + 49]) as h1, md5_number(array_to_string(w[i:i + 49], ' ')) as h2 from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50)),
 f as (select h1, h2, min(doc_id) as f from x group by 1, 2),
 g as (select distinct doc_id, unnest(range(i, i + 50)) as p from x join f using (h1, h2) where f < doc_id),
 k as (select doc_id, list(p) as gone from g group by 1)
 select d.doc_id, len(w)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed, sha256(array_to_string(case when gone is null then w else list_filter(w, lambda a, i: not list_contains(gone, i)) end, ' ')) as kept_sha256 from d left join k using (doc_id)""",
    "op11_lexical": f"""with d as (select row_number() over () as r, doc_id, {_WORDS.format(_LOW)} as w from documents), x as (select r, unnest(w) as term from d),
 c as (select r, term, count(*) as tf from x group by 1, 2), z as (select r, doc_id, len(w) as n from d where len(w) > 0),
 a as (select count(*) as n_docs, sum(n)::bigint as l from z), w as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from c, a group by term, n_docs),
 p as (select r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * n_docs) // l)))) as p from c join z using (r) join w using (term), a),
 q as (select item_id, unnest({_WORDS.format(_LOW)}) as term from (select distinct item_id, text from benchmark)),
 s as (select item_id, r, doc_id, sum(p)::bigint as score from q join p using (term) group by 1, 2, 3)
 select item_id, rank, doc_id, score from (select *, (row_number() over (partition by item_id order by score desc, doc_id nulls first))::int as rank from s where score > 0) where rank <= 10""",
    "op12_importance": f"""with d as (select row_number() over () as r, doc_id, {_WORDS.format(_LOW)} as w from documents), b as (select {_WORDS.format(_LOW)} as w from benchmark),
 fd as (select r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from d),
 fb as (select unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from b),
 step as (select list(list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(3988292384::bigint, c >> 1) else c >> 1 end, i) order by i) as t from range(256) x(i)),
 u as (select f, hex(encode(f)) as h from (select distinct f from (select f from fd union all select f from fb))),
 c as (select f, xor(list_reduce(list_transform(range(1, len(h), 2), lambda i: ('0x' || h[i:i + 1])::bigint), lambda c, x: xor(t[xor(c & 255, x) + 1], c >> 8), 4294967295::bigint), 4294967295::bigint) % 10000 as k from u, step),
 nd as (select r, k, count(*) as n from fd join c using (f) group by 1, 2), s as (select k, sum(n) as s from nd group by 1),
 t as (select k, count(*) as t from fb join c using (f) group by 1),
 g as (select k, floor(1000 * ln(((coalesce(t, 0) + 1) * ((select sum(s) from s) + 10000))::double / ((s + 1) * ((select coalesce(sum(t), 0) from t) + 10000))::double)) as g from s left join t using (k)),
 a as (select r, sum(n)::bigint as n, floor(sum(n * g) / sum(n))::bigint as weight from nd join g using (k) group by 1),
 z as (select r, doc_id, len(w) as n_words, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(doc_id::varchar, 'null'))[1:8])::bigint + 0.5) / 4294967296)))::bigint as score from d left join a using (r)),
 p as (select r, row_number() over (order by score desc, doc_id nulls first) as p, count(*) over () as n from z where n_words >= 20)
 select doc_id, n_features::bigint as n_features, weight, score, case when p <= n * 25 // 100 then p end::bigint as rank from z left join p using (r)""",
    "op13_warc": """with p as (select page_id, encode(coalesce(html, '')) as b from pages), h as (select page_id, b, octet_length(b)::bigint as n, sha1(b) as x, max(page_id) over (partition by b) as top from p)
 select page_id, n as payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(((('0x' || x[10 * (i // 8) + 1:10 * (i // 8) + 10])::bigint >> (35 - 5 * (i % 8))::int) & 31) + 1)::int]), '') as payload_digest,
 case when page_id is not distinct from top then 'response' else 'revisit' end as record_type, case when page_id is distinct from top then top end as refers_to from h""",
}
