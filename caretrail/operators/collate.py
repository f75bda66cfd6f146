"""Token rows to model input: ids, sequences with markers, targets, packed storage."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config as C
from . import segments

def _subject():
    return W.partitionBy("subject_id")



def next_types(windows: DataFrame) -> DataFrame:
    return windows.select("subject_id", "window_ord", "type_id", F.lead("type_id").over(_subject().orderBy("window_ord")).alias("next_type"))


def next_tokens(rows: DataFrame) -> DataFrame:
    """Each token with the next of its window; ends marks the last."""
    w = W.partitionBy("subject_id", "window_ord").orderBy("idx")
    return rows.select("subject_id", "idx", "window_ord", "surface", F.lead("surface").over(w).alias("next_surface"), F.lead("idx").over(w).isNull().alias("ends"))


def overflow(windows: DataFrame, most: int) -> DataFrame:
    """What a cap on windows would drop of each subject."""
    kept = F.col("window_ord") < most
    return windows.groupBy("subject_id").agg(F.count("*").alias("windows"), F.count_if(kept).alias("kept_windows"), F.sum(F.when(kept, 0).otherwise(F.col("n_tokens"))).alias("dropped_tokens"))


def compact(tokens: DataFrame) -> DataFrame:
    """kind, surface, dense_id (from 1) and n of the surfaces that occur."""
    k = tokens.groupBy("kind", "surface").agg(F.count("*").alias("n"))
    return k.withColumn("dense_id", F.row_number().over(W.orderBy("kind", "surface")).cast("long"))


def token_ids(tokens: DataFrame, first: int = 100) -> DataFrame:
    """kind, surface and token_id, clear of the markers' ids."""
    return compact(tokens).select("kind", "surface", (F.col("dense_id") + first - 1).alias("token_id"))


def special_arrays(specials: DataFrame) -> DataFrame:
    """subject_id (and trajectory_ord if there is one) and specials, the array of id and value
    in order, of specials(subject_id, ord, token_id, value)."""
    keys = [c for c in ("subject_id", "trajectory_ord") if c in specials.columns]
    one = specials.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ord", F.col("token_id").cast("long").alias("id"), "value"))).alias("s"))
    return one.select(*keys, F.transform("s", lambda x: F.struct(x["id"].alias("id"), x["value"].alias("value"))).alias("specials"))


def collated(tokens: DataFrame, specials: DataFrame | None, length: int, cap: int = C.CHUNK_CAP, markers: bool = True) -> DataFrame:
    """``segments.chunked_windows`` of tokens with ids, with each subject's specials (as
    ``special_arrays`` gives them): chunks are cut to what ``length`` leaves beside the
    specials and two markers."""
    none = F.array().cast("array<struct<id:bigint,value:double>>")
    t = tokens.withColumn("specials", none) if specials is None else tokens.join(specials, "subject_id", "left").withColumn("specials", F.coalesce("specials", none))
    most = content_budget(length, F.size("specials"), markers)
    return segments.chunked_windows(t, most, cap, ("idx", "t_us", "gid", "value", "category"), carry=("specials",))


def sequences(windows: DataFrame, length: int, most_windows: int = C.WINDOW_CAP, end_mode: str = "end_token") -> DataFrame:
    """One row a chunk of ``collated`` windows, of each subject's first most_windows: ids,
    times (hours from the chunk's start), values, value_mask, types (categories) and mask, all
    of ``length``; window_type, offset_h (of the chunk in its window), last, n_tokens and span_h
    of the chunk, window_tokens and window_h.

    A chunk holds the specials, its window's type, its tokens, and CONTINUE, or (the last one
    kept) END or the type of the next window. Only medications and specials have values."""
    w = _subject().orderBy("window_ord")
    kind = F.when(F.col("type_id").between(0, len(C.WINDOW_TYPES) - 1), F.col("type_id")).otherwise(C.WINDOW_TYPES["UNK"])
    rows = windows.where(F.col("window_ord") < most_windows).withColumn("kind", kind)
    rows = rows.withColumns({"next_type": F.lead("kind").over(w), "next_us": F.lead("start_us").over(w)})
    sized = F.transform("sizes", lambda n, i: F.struct(n.alias("n"), F.aggregate(F.slice("sizes", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x).alias("at")))
    rows = rows.select("*", F.posexplode(sized).alias("chunk_ord", "c"))
    rows = rows.withColumns({"x": F.slice("x", (F.col("c.at") + 1).cast("int"), F.col("c.n").cast("int")), "last": F.col("chunk_ord") == F.size("sizes") - 1})
    rows = rows.withColumns({"begin": F.get("x.t_us", F.lit(0)), "end": F.get("x.t_us", F.size("x") - 1)})
    hours = lambda us: F.greatest((us - F.col("begin")) / 3.6e9, F.lit(0.0))
    onward = F.col("last") & F.col("next_type").isNotNull() & F.lit(end_mode == "next_type")
    put = F.slice("x", F.lit(1), F.greatest(F.lit(length - 2) - F.size("specials"), F.lit(0)))
    s, zero, one = F.col("specials"), F.lit(0), F.lit(1)
    drug = lambda x: (x["category"] == "MEDICATION") & x["value"].isNotNull()
    category = lambda x: F.array_position(F.array(*map(F.lit, C.CATEGORIES)), x["category"]).cast("int") - 1
    pad = lambda z, *parts: F.slice(F.concat(*parts, F.array_repeat(z, length)), 1, length)
    number = lambda x, ok: F.when(ok, x).otherwise(0.0)
    suffix = chunk_suffix(F.col("last"), F.col("next_type"), end_mode).cast("long")
    special = lambda x: numeric_channel(x["value"])
    return rows.select(
        "subject_id", "window_ord", F.col("chunk_ord").cast("long").alias("chunk_ord"),
        pad(F.lit(0).cast("long"), F.col("specials.id"), F.array((F.lit(C.TYPE_TOKEN) + F.col("kind")).cast("long")), F.transform(put, lambda x: x["gid"]), F.array(suffix)).alias("ids"),
        pad(F.lit(0.0), F.transform(s, lambda x: F.lit(0.0)), F.array(F.lit(0.0)), F.transform(put, lambda x: hours(x["t_us"])), F.array(hours(F.when(onward, F.col("next_us")).otherwise(F.col("end"))))).alias("times"),
        pad(F.lit(0.0), F.transform(s, lambda x: special(x)[0]), F.array(F.lit(0.0)), F.transform(put, lambda x: number(x["value"], drug(x))), F.array(F.lit(0.0))).alias("values"),
        pad(zero, F.transform(s, lambda x: special(x)[1]), F.array(zero), F.transform(put, lambda x: drug(x).cast("int")), F.array(zero)).alias("value_mask"),
        pad(zero, F.transform(s, lambda x: zero), F.array(zero), F.transform(put, category), F.array(zero)).alias("types"),
        pad(zero, F.array_repeat(one, F.size(s) + F.size(put) + 2)).alias("mask"),
        F.col("kind").alias("window_type"), F.greatest((F.col("begin") - F.col("start_us")) / 3.6e9, F.lit(0.0)).alias("offset_h"), "last", F.size("x").alias("n_tokens"), ((F.col("end") - F.col("begin")) / 3.6e9).alias("span_h"),
        F.col("n_tokens").alias("window_tokens"), ((F.col("end_us") - F.col("start_us")) / 3.6e9).alias("window_h"),
    )


def overflow_report(windows: DataFrame, most_windows: int = C.WINDOW_CAP) -> DataFrame:
    """What the caps of ``sequences`` leave out of ``collated`` windows, as one row of counts
    and shares: each subject's are summed first."""
    kept = F.col("window_ord") < most_windows
    held = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    inside = F.size(F.filter(F.slice("x", F.lit(1), held.cast("int")), lambda x: x["category"] == "STRUCTURAL"))
    of = lambda test, n: F.sum(F.when(test, n).otherwise(0))
    s = windows.groupBy("subject_id").agg(
        F.count("*").alias("windows"), F.count_if(kept).alias("kept"), of(~kept, F.col("n_tokens")).alias("tokens"), of(~kept, F.col("n_structural")).alias("structural"),
        of(kept, F.col("n_chunks") - F.size("sizes")).alias("chunks"), of(kept, F.col("n_tokens") - held).alias("chunk_tokens"), of(kept, F.col("n_structural") - inside).alias("chunk_structural"),
    )
    over = (F.col("kept") < F.col("windows")) | (F.col("chunks") > 0) | (F.col("tokens") > 0) | (F.col("chunk_tokens") > 0)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    t = s.agg(
        F.count("*").alias("subjects"), F.count_if(over).alias("subjects_with_overflow"), zero("windows").alias("windows_total"), zero("kept").alias("windows_kept"), zero("tokens").alias("tokens_dropped"), zero("structural").alias("structural_dropped"),
        zero("chunks").alias("chunks_dropped"), zero("chunk_tokens").alias("chunk_tokens_dropped"), zero("chunk_structural").alias("chunk_structural_dropped"),
    )
    share = lambda a, b: a / F.greatest(F.lit(1), b)
    dropped = F.col("windows_total") - F.col("windows_kept")
    return t.withColumns({"windows_dropped": dropped, "subjects_with_overflow_share": share(F.col("subjects_with_overflow"), F.col("subjects")), "windows_dropped_share": share(dropped, F.col("windows_total"))})


def blocks(spark: SparkSession, layout: dict[str, tuple[int, int]]) -> DataFrame:
    """family, lo, hi and dense_offset of id blocks(offset, size) laid end to end."""
    b = spark.createDataFrame([(k, int(v), int(v + n - 1)) for k, (v, n) in layout.items()], "family string, lo long, hi long")
    w = W.orderBy("lo").rowsBetween(W.unboundedPreceding, -1)
    return b.withColumn("dense_offset", F.coalesce(F.sum(F.col("hi") - F.col("lo") + 1).over(w), F.lit(0)))


def remap(ids: DataFrame, table: DataFrame, unknown: int = -1) -> DataFrame:
    """gid with its dense_id. The id blocks are a fixed list of families, so the range
    join is a broadcast one."""
    hit = ids.join(F.broadcast(table), (F.col("gid") >= F.col("lo")) & (F.col("gid") <= F.col("hi")), "left")
    return hit.select("gid", "family", F.coalesce(F.col("dense_offset") + F.col("gid") - F.col("lo"), F.lit(unknown)).alias("dense_id"))


def items(tokens: DataFrame) -> DataFrame:
    """Tokens fused to readable items: observation pairs and marked codes as one."""
    w = _subject().orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    item = F.sum(F.when(F.col("kind").isin("OBS_VALUE", "MARK"), 0).otherwise(1)).over(w) - 1
    return tokens.withColumn("item", item).groupBy("subject_id", "item").agg(F.min("idx").alias("idx"), F.count("*").alias("n_tokens"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "surface"))), lambda x: x["surface"]), "=").alias("text"))


def legal(state: Column, token: Column, boundary: Column) -> Column:
    """Whether a token may follow: content inside a chunk; CONTINUE at its end, END or a
    type too at a boundary; a type after a window."""
    kind = token.between(C.TYPE_TOKEN, C.TYPE_TOKEN + len(C.WINDOW_TYPES) - 1)
    marker = kind | token.isin(C.END_TOKEN, C.CONTINUE_TOKEN)
    return F.when(state == "inside", ~marker).when(state == "chunk_end", (token == C.CONTINUE_TOKEN) | (boundary & ((token == C.END_TOKEN) | kind))).otherwise(kind)


def illegal_rates(rows: DataFrame) -> DataFrame:
    """state, boundary, n, illegal and its rate of rows(state, boundary, legal)."""
    n = rows.groupBy("state", "boundary").agg(F.count("*").alias("n"), F.count_if(~F.col("legal")).alias("illegal"))
    return n.withColumn("illegal_rate", F.col("illegal") / F.col("n"))


#: Tokens that are packed in a row at most.
PACKED = 4096


def pack(tokens: DataFrame, most: int = PACKED) -> DataFrame:
    """A subject's tokens as parallel arrays in order, up to ``most`` places of the history in
    a row: subject_id, block and the columns."""
    cols = ("idx", "kind", "surface", "category", "t_us", "dt_us")
    one = tokens.withColumn("block", F.floor(F.col("idx") / most)).groupBy("subject_id", "block").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("x"))
    return one.select("subject_id", "block", *[F.col(f"x.{c}").alias(c) for c in cols])


def unpack(packed: DataFrame) -> DataFrame:
    cols = [c for c in packed.columns if c not in ("subject_id", "block")]
    return packed.select("subject_id", F.explode(F.arrays_zip(*cols)).alias("x")).select("subject_id", *[f"x.{c}" for c in cols])


def index(events: DataFrame, splits: DataFrame, per_shard: int) -> DataFrame:
    """subject_id, shard, subject_idx, split and n: where each subject's timeline lies."""
    n = events.groupBy("subject_id").agg(F.count("*").alias("n")).withColumn("shard", F.floor(F.col("subject_id") / per_shard))
    n = n.withColumn("subject_idx", F.row_number().over(W.partitionBy("shard").orderBy("subject_id")).cast("long") - 1)
    return n.join(splits, "subject_id", "left").select("subject_id", "shard", "subject_idx", F.coalesce("split", F.lit("<missing>")).alias("split"), "n")


def write_shards(tokens: DataFrame, path: str, shards: int) -> None:
    """Timelines as Parquet, a subject in one shard and in order there."""
    tokens.withColumn("shard", F.pmod(F.xxhash64("subject_id"), F.lit(shards))).repartition("shard").sortWithinPartitions("subject_id", "idx").write.mode("append").partitionBy("shard").parquet(path)


def codebooks(levels: int, size: int, seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    return [np.sort(rng.normal(0, 6.0 / 4**i, size)) for i in range(levels)]


def quantised(samples: DataFrame, levels: int = 2, size: int = 256, seed: int = 7) -> DataFrame:
    """samples with code: the value (on a log scale) by residual quantisation, each level
    the nearest of ``size`` codes to what the ones before left. The codebooks follow from
    the seed; batches are compared at once."""
    books = codebooks(levels, size, seed)

    @F.pandas_udf("long")
    def code(v: pd.Series) -> pd.Series:
        x = np.sign(v.to_numpy()) * np.log1p(np.abs(v.to_numpy()))
        out = np.zeros(len(x), np.int64)
        for i, b in enumerate(books):
            at = np.clip(np.searchsorted(b, x), 1, size - 1)
            at -= (x - b[at - 1]) < (b[at] - x)
            out += at * size**i
            x = x - b[at]
        return pd.Series(out)

    return samples.withColumn("code", code("value"))


def embedding_table(vocab: DataFrame, embeddings: DataFrame, dims: int) -> DataFrame:
    """raw_id, vector (scaled to length 1; zeros if there is none of that many
    dimensions) and has_vector of vocab(code, raw_id) with embeddings(code, vector)."""
    good = embeddings.where(F.size("vector") == dims)
    j = vocab.join(good, "code", "left")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    scaled = F.when(norm > 0, F.transform("vector", lambda x: x / norm)).otherwise(F.col("vector"))
    return j.select("raw_id", F.coalesce(scaled, F.array_repeat(F.lit(0.0), dims)).alias("vector"), F.col("vector").isNotNull().alias("has_vector"))


def window_type_by_key(rows: DataFrame) -> DataFrame:
    """The type of a window by the first of its tokens that bears one (the rule of the
    collator; segmentation looks at the first token only)."""
    return rows.groupBy("subject_id", "window_ord").agg(F.coalesce(F.min_by("type_id", F.when(F.col("type_id").isNotNull(), F.col("idx"))), F.lit(0)).alias("type_id"))


def chunk_tokens(tokens: DataFrame, **sizes) -> DataFrame:
    """window_tokens with chunk_ord and at, the place in the chunk."""
    chunk = segments.chunks(tokens, **sizes).groupBy("subject_id", "window_ord").agg(F.sort_array(F.collect_list("from_pos")).alias("from"))
    w = W.partitionBy("subject_id", "window_ord")
    rows = segments.window_tokens(tokens).withColumn("nth", F.row_number().over(w.orderBy("idx")) - 1).join(chunk, ["subject_id", "window_ord"])
    rows = rows.withColumn("chunk_ord", F.size(F.filter("from", lambda x: x <= F.col("nth"))) - 1)
    return rows.withColumn("at", F.col("nth") - F.get("from", F.col("chunk_ord"))).drop("from", "nth")


def chunk_targets(rows: DataFrame) -> DataFrame:
    """Of each chunk of chunk_tokens its tokens, hours from its start, the offset of its
    start in its window, and whether it ends the window."""
    c = rows.groupBy("subject_id", "window_ord", "chunk_ord").agg(F.count("*").alias("n_tokens"), F.min("t_us").alias("start_us"), F.max("t_us").alias("end_us"))
    w = W.partitionBy("subject_id", "window_ord")
    return c.select("subject_id", "window_ord", "chunk_ord", "n_tokens", (F.col("end_us") - F.col("start_us")).alias("span_us"), (F.col("start_us") - F.min("start_us").over(w)).alias("offset_us"), (F.col("chunk_ord") == F.max("chunk_ord").over(w)).alias("ends_window"))


def chunk_next(rows: DataFrame) -> DataFrame:
    """Each token of chunk_tokens with the next of its chunk, and whether it is the last."""
    w = W.partitionBy("subject_id", "window_ord", "chunk_ord").orderBy("idx")
    return rows.select("subject_id", "idx", "window_ord", "chunk_ord", "surface", F.lead("surface").over(w).alias("next_surface"), F.lead("idx").over(w).isNull().alias("chunk_end"))


def window_targets(windows: DataFrame) -> DataFrame:
    """Of each window its tokens and span, and the type, tokens and span of the next one."""
    w = _subject().orderBy("window_ord")
    span = F.col("end_us") - F.col("start_us")
    t = windows.select("subject_id", "window_ord", "type_id", "n_tokens", span.alias("span_us"))
    return t.select("*", F.lead("type_id").over(w).alias("next_type"), F.lead("n_tokens").over(w).alias("next_tokens"), F.lead("window_ord").over(w).isNotNull().alias("has_next"))


def numeric_channel(value: Column) -> tuple[Column, Column]:
    """A finite number and 1, else 0 and 0."""
    ok = F.coalesce(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))
    return F.when(ok, value).otherwise(0.0), ok.cast("int")


def content_budget(length: int, specials: Column, markers: bool = True) -> Column:
    """How many content tokens a chunk of that length has room for."""
    return F.greatest(F.lit(1), F.lit(length - (2 if markers else 0)) - specials)


def chunk_suffix(last: Column, next_type: Column, end_mode: str = "end_token") -> Column:
    """The marker that ends a chunk: CONTINUE, END, or in the mode next_type the type of
    the next window if there is one."""
    following = F.lit(C.TYPE_TOKEN) + F.when(next_type.between(0, len(C.WINDOW_TYPES) - 1), next_type).otherwise(C.WINDOW_TYPES["UNK"])
    end = F.when(next_type.isNotNull(), following).otherwise(C.END_TOKEN) if end_mode == "next_type" else F.lit(C.END_TOKEN)
    return F.when(~last, C.CONTINUE_TOKEN).otherwise(end)


def trajectory_index(rows: DataFrame, per_shard: int = 512) -> DataFrame:
    """subject_id, trajectory_ord, n_tokens, trajectory_id and shard of tokens with a
    trajectory_ord: ids count trajectories in order, a bounded stretch of subjects a task."""
    t = rows.groupBy("subject_id", "trajectory_ord").agg(F.count("*").alias("n_tokens")).withColumn("b", F.shiftright("subject_id", 12))
    start = t.groupBy("b").agg(F.count("*").alias("k"))
    start = start.select("b", F.coalesce(F.sum("k").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    nth = F.row_number().over(W.partitionBy("b").orderBy("subject_id", "trajectory_ord")).cast("long") - 1
    out = t.withColumn("nth", nth).join(start, "b").withColumn("trajectory_id", F.col("start") + F.col("nth"))
    return out.select("subject_id", "trajectory_ord", "n_tokens", "trajectory_id", F.floor(F.col("trajectory_id") / per_shard).alias("shard"))


def write_trajectories(rows: DataFrame, path: str, per_shard: int = 512) -> None:
    """Tokens with a trajectory_ord as Parquet, ``per_shard`` trajectories a shard."""
    index = trajectory_index(rows, per_shard).drop("n_tokens")
    out = rows.join(index, ["subject_id", "trajectory_ord"])
    out.repartition("shard").sortWithinPartitions("trajectory_id", "idx").write.mode("overwrite").partitionBy("shard").parquet(path)


ATTRIBUTES = ("type_id", "adm", "tra", "dis", "dea", "edl", "icu", "orl")


def attributes(tokens: DataFrame) -> Column:
    """The integer attributes that a token has, as a map."""
    each = [F.struct(F.lit(c).alias("key"), F.col(c).cast("long").alias("value")) for c in ATTRIBUTES if c in tokens.columns]
    return F.map_from_entries(F.filter(F.array(*each), lambda x: x["value"].isNotNull() & ((x["key"] == "type_id") | (x["value"] != 0))))


def csr(rows: DataFrame, most: int = PACKED) -> DataFrame:
    """The maps of rows(subject_id, idx, attrs) end to end, up to ``most`` places of a history
    in a row: subject_id, block, idx, offsets, keys (in order) and values."""
    e = rows.select("subject_id", "idx", F.floor(F.col("idx") / most).alias("block"), F.array_sort(F.map_entries(F.coalesce("attrs", F.create_map().cast("map<string,bigint>")))).alias("e"))
    so_far = W.partitionBy("subject_id", "block").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    e = e.withColumn("end", F.sum(F.size("e")).over(so_far).cast("int"))
    one = e.groupBy("subject_id", "block").agg(F.sort_array(F.collect_list(F.struct("idx", "end", "e"))).alias("x"))
    flat = F.flatten("x.e")
    return one.select("subject_id", "block", F.col("x.idx").alias("idx"), F.concat(F.array(F.lit(0)), F.col("x.end")).alias("offsets"), F.transform(flat, lambda e: e["key"]).alias("keys"), F.transform(flat, lambda e: e["value"]).alias("values"))


def uncsr(packed: DataFrame) -> DataFrame:
    """The maps of ``csr`` again: subject_id, idx and attrs."""
    bounds = F.transform("idx", lambda at, i: F.struct(at.alias("idx"), F.get("offsets", i).alias("a"), F.get("offsets", i + 1).alias("b")))
    rows = packed.select("subject_id", "keys", "values", F.explode(bounds).alias("r"))
    cut = lambda c: F.slice(c, F.col("r.a") + 1, F.col("r.b") - F.col("r.a"))
    return rows.select("subject_id", F.col("r.idx").alias("idx"), F.map_from_arrays(cut("keys"), cut("values")).alias("attrs"))
