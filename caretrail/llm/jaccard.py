"""Exact self-join of word-shingle sets by Jaccard similarity, and its groups.

Sets under the Jaccard distance d are a metric space. Two documents link when
d <= r = 1 - threshold. Almost all documents are at distance 1 from each other, where
no pivot tells them apart; so pivots stand at the shingles:

1. Each set is indexed under the first shingles of one global (hash) order, enough
   that linked sets share K or more of them. Shingles of one document fall away, and
   so do documents with fewer than K shared ones.
2. The smallest document under a shingle is its *pivot*; a document belongs to the
   Voronoi regions of the pivots that hold most of its shared shingles. It may leave
   out pivots that hold fewer than K / 2 together, so a linked pair still meets.
3. The distance to the pivot is computed exactly. Within r it is a link. Two members
   x, y can link only if |d(x, p) - d(y, p)| <= r (triangle inequality).
4. A region whose members are all connected by now is finished. Others are joined,
   in place if small; larger ones get new pivots, each document goes to the nearest
   (distance a) and, as a boundary document, to all pivots within a + 2r; the parts
   are joined recursively. Where the windows triple a
   region's members, nothing is gained: it is joined block by block.

Nothing is dropped or capped: the groups are those of all linked pairs. Shingles are
compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import NOT_SPACE, Words, dropped, mix, pieces, saved, shingle_sets
from .components import components
from .exchange import meet


def _sets(column, k: int):
    """The shingle sets of a string column, in order, piece by piece."""
    for at, data, bounds in pieces(column):
        yield at, shingle_sets(Words(data, bounds, NOT_SPACE, lower=True), k)


def _least(n: np.ndarray, pct: int) -> np.ndarray:
    """Shingles that a set of n shares with any set it links to, at least."""
    return (n * pct + 99) // 100


def _shared(n, pct: int):
    """K: how many of the indexed shingles of a set of n two linked sets share. Small
    sets are indexed whole."""
    return np.where(n <= 100, _least(n, pct), np.maximum(1, np.where(n <= 400, 2 * n // 5, n // 10)))


def _shared_at_least(n, pct: int):
    """The least K among the sizes that a set of n may link to. K grows with n but for
    its steps, so it is the least of the first sizes of each stretch."""
    low, high = _least(n, pct), n * 100 // pct
    out = _shared(low, pct)
    for m in (101, 401):
        out = np.where((low <= m) & (m <= high), np.minimum(out, _shared(np.int64(m), pct)), out)
    return np.maximum(1, out)


def features(docs: DataFrame, k: int, pct: int) -> DataFrame:
    """doc_id, n (set size), k (indexed shingles it shares with any set it links to, at
    least), sig (two hashes of the set) and the indexed shingles."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for at, sets in _sets(batch.column(1), k):
                n = np.array([len(s) for s in sets], np.int64)
                take = np.minimum(n, n - _least(n, pct) + _shared(n, pct))
                share = _shared_at_least(n, pct)
                flat = np.concatenate(sets)
                first = np.r_[0, np.cumsum(n)]
                sig = []
                for salt in (1, 2):
                    sums = np.r_[np.uint64(0), np.cumsum(mix(flat + np.uint64(salt)))]
                    sig.append(mix(sums[first[1:]] - sums[first[:-1]] + n.astype(np.uint64)).view(np.int64))
                index = pa.array([s[:t].view(np.int64) for s, t in zip(sets, take, strict=True)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(sets)), pa.array(n), pa.array(share), pa.array(sig[0]), pa.array(sig[1]), index], names=["doc_id", "n", "k", "sig", "sig2", "indexed"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, k long, sig long, sig2 long, indexed array<long>")


def _emit(batch):
    """(shingle, document, K) rows; of equal sets in a run of them only the first."""
    for i in range(0, batch.num_rows, 1024):
        part = batch.slice(i, 1024)
        part = part.take(pa.array(np.unique(part.column(2).to_numpy(), return_index=True)[1]))
        index = part.column(1)
        yield index.flatten().to_numpy(), *(np.repeat(part.column(c).to_numpy(), index.value_lengths().to_numpy()) for c in (0, 3))


def distances(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """pairs(x, p, ...) with the sizes n_x, n_p and the intersection of their sets."""
    extra = [c for c in pairs.columns if c not in ("x", "p")]
    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    # both sides grow with the corpus: neither is broadcast, however small it is by now
    both = pairs.join(side("x").hint("merge"), "x").join(side("p").hint("merge"), "p").select("x", "p", *extra, "text_x", "text_p")
    schema = pairs.select("x", "p", *extra).schema.add("n_x", "long").add("n_p", "long").add("both", "long")

    def run(batches):
        for batch in batches:
            n = batch.num_columns
            p = batch.column(1).to_numpy()
            new, back = np.unique(p, return_index=True, return_inverse=True)[1:]
            right = [s for _, sets in _sets(batch.column(n - 1).take(pa.array(new)), k) for s in sets]
            left = [s for _, sets in _sets(batch.column(n - 2), k) for s in sets]
            size = [(len(a), len(b), len(np.intersect1d(a, b, assume_unique=True))) for a, b in zip(left, (right[i] for i in back), strict=True)]
            made = np.array(size, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*batch.columns[: n - 2], *(pa.array(made[:, i]) for i in range(3))], names=schema.names)

    return both.mapInArrow(run, schema)


def _joined(group: pd.DataFrame, k: int, pct: int) -> pd.DataFrame:
    """Links that connect the members of one small part further: of two members that
    are not connected yet and whose distances to the pivot differ by r at most."""
    group = group.sort_values(["dist", "x"]).reset_index(drop=True)
    sets = [s for _, some in _sets(pa.array(group.text, pa.string()), k) for s in some]
    n, dist, r = [len(s) for s in sets], group.dist.to_numpy(), 1 - pct / 100 + 1e-9
    root = {c: c for c in group.comp}

    def find(c):
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    found = []
    comp, x = group.comp.tolist(), group.x.tolist()
    for j in range(len(sets)):
        for i in range(int(np.searchsorted(dist, dist[j] - r)), j):
            if 100 * min(n[i], n[j]) < pct * max(n[i], n[j]) or find(comp[i]) == find(comp[j]):
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= pct * (n[i] + n[j] - both):
                found.append((x[i], x[j]))
                root[find(comp[j])] = find(comp[i])
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def _blocks(big: DataFrame, region: int) -> DataFrame:
    """Parts cut into blocks of half a region, each pair of blocks a part of its own."""
    blocks = big.withColumn("g", F.ceil(F.col("m") * 2 / region)).withColumn("b", F.pmod(F.xxhash64("x"), F.col("g")))
    pairs = blocks.select("part", "x", "dist", "comp", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)).alias("o"))
    return pairs.select(F.concat_ws("/", "part", F.least("b", "o"), F.greatest("b", "o")).alias("part"), "x", "dist", "comp")


def jaccard_groups(docs: DataFrame, k: int = 5, threshold_pct: int = 80, region: int = 256, depth: int = 3) -> DataFrame:
    """doc_id, n_shingles and component_id of every document of docs(doc_id, text).

    Words are split at ASCII white space, A-Z in lower case; a set holds the distinct
    k-word shingles, or the whole sequence of a shorter text. Documents link when
    100 * intersection >= threshold_pct * union; component_id is the smallest doc_id
    reachable by links, itself included. Null and empty texts have empty sets and link
    with nothing. doc_id names a document: rows that repeat a doc_id should repeat its
    text too, and each gets a row. A null doc_id has a null component and links with
    nothing. Other columns are not read. region: members of a part that one task joins.
    """
    pct = threshold_pct
    feats = saved(features(docs, k, pct), "sets")
    sized = feats.where("doc_id is not null and n > 0")
    classes = saved(sized.groupBy("sig", "sig2", "n").agg(F.min("doc_id").alias("rep")), "classes")

    # 1. shingles of two documents or more, and the documents with enough of them
    shared = meet(sized.select("doc_id", "indexed", "sig", "k"), _emit).select(F.col("key").alias("s"), F.col("owner").alias("x"), F.col("tag").alias("k"))
    rows = saved(shared.withColumn("m", F.count("*").over(W.partitionBy("x"))).where("m >= k").drop("m"), "able")

    # 2. pivots and regions
    pivots = rows.groupBy("s").agg(F.min("x").alias("p"), F.count("*").alias("m")).where("m > 1")
    held = rows.join(pivots.select("s", "p"), "s").groupBy("x", "p").agg(F.count("*").alias("c"), F.first("k").alias("k"))
    up = W.partitionBy("x").orderBy("c", "p")
    held = held.withColumn("sum", F.sum("c").over(up.rowsBetween(W.unboundedPreceding, 0))).withColumn("all", F.sum("c").over(W.partitionBy("x")))
    part = saved(held.where("all >= k and sum > floor((k - 1) / 2)").select("x", "p"), "regions")
    ids = part.select(F.col("x").alias("doc_id")).union(part.select("p")).distinct()
    texts = saved(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(ids.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")

    # 3. distances to the pivot
    linked = f"100 * both >= {pct} * (n_x + n_p - both)"
    dist = F.lit(1.0) - F.col("both") / (F.col("n_x") + F.col("n_p") - F.col("both"))
    far = saved(distances(part.where("x <> p"), texts, k).withColumn("dist", dist), "distances")
    links = far.where(linked).select(F.col("x").alias("a"), F.col("p").alias("b"))
    groups = components(links)

    # 4. regions with members that are not connected yet
    member = far.select("x", "p", "dist").union(part.select("p").distinct().select(F.col("p").alias("x"), "p", F.lit(0.0)))
    member = member.join(groups.select(F.col("node").alias("x"), "component"), "x", "left").select(F.col("p").cast("string").alias("part"), "x", "dist", F.coalesce("component", "x").alias("comp"))
    size = lambda m: m.groupBy("part").agg(F.count("*").alias("m"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    open_ = saved(member.join(size(member).select("part", "m"), "part"), "open")
    leaves, more, used = [], [], [rows, part, texts, far, open_]
    for level in range(depth + 1):
        big = open_.where(F.col("m") > region)
        leaves.append(open_.where(F.col("m") <= region).select("part", "x", "dist", "comp"))
        if big.isEmpty():
            break
        if level == depth:
            leaves.append(_blocks(big, region))
            break
        salt = F.pmod(F.xxhash64("x", F.lit(level)), F.lit(8))
        new = big.groupBy("part", salt.alias("salt")).agg(F.min("x").alias("p")).select("part", "p")
        near = saved(distances(big.select("part", "x", "comp", "m").join(new, "part").where("x <> p"), texts, k).withColumn("dist", dist), "near")
        more.append(near.where(linked).select(F.col("x").alias("a"), F.col("p").alias("b")))
        own = new.join(big.select("part", F.col("x").alias("p"), "comp", "m"), ["part", "p"]).select("part", F.col("p").alias("x"), "p", "comp", "m", F.lit(0.0).alias("dist"))
        best = F.min("dist").over(W.partitionBy("part", "x"))
        sub = near.select("part", "x", "p", "comp", "m", "dist").union(own).withColumn("best", best).where(F.col("dist") <= F.col("best") + 2 * (1 - pct / 100) + 1e-9)
        grown = sub.groupBy("part").agg(F.count("*").alias("all"), F.first("m").alias("m")).where("all > 3 * m").select("part")
        leaves.append(_blocks(big.join(grown, "part", "left_semi"), region))
        sub = sub.join(grown, "part", "left_anti").select(F.concat_ws("/", "part", "p").alias("part"), "x", "dist", "comp")
        open_ = saved(sub.join(size(sub).select("part", "m"), "part"), "open")
        used += [near, open_]
    last = leaves[0]
    for leaf in leaves[1:]:
        last = last.union(leaf)
    last = last.join(texts.select(F.col("doc_id").alias("x"), "text"), "x")
    # documents with equal sets go by the smallest
    copies = feats.where("n > 0").select("doc_id", "sig", "sig2", "n").join(classes, ["sig", "sig2", "n"]).select("doc_id", "rep")
    same = copies.join(ids, "doc_id").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    for found in [same, last.groupBy("part").applyInPandas(lambda g: _joined(g, k, pct), "a long, b long"), *more]:
        links = links.union(found)
    final = components(links)
    dropped(*used)

    whole = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("sig", "sig2", "n", F.coalesce("component", "rep").alias("component"))
    out = feats.select("doc_id", "n", "sig", "sig2").join(whole, ["sig", "sig2", "n"], "left")
    group = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), group.alias("component_id"))
