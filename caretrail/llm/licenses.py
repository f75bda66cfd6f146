"""Scan of texts for licence notices, with DataFrame functions only.

Texts are cut into overlapping windows, as wide as twice a template and half
overlapping, so that some window holds any notice whole. Windows and templates are sets
of k-word shingles; a template of fewer words is one shingle of all of them, and its
windows are cut into shingles of as many. MinHash bands of the windows are joined with those of the templates.
The least Jaccard similarity j of a template to a window that holds the asked share of
it follows from its length (1/6 for five words, which make one shingle of six), and
``bands`` bands of one hash miss it with a probability of (1 - j) ** bands. Each length
has as many bands as bring that to MISS or less (see ``_needed``). The retrieved templates are verified exactly: the share of
their shingles in the window must reach ``percent``.

A window with the asked share of a template's shingles holds one of a few words that
these have (see ``_anchors``). So texts and windows without any are left out first.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Public licence notices, as they are commonly written (fixed values).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "All-rights-reserved": "All rights reserved",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}

#: Most that the probability of missing a window that counts may be.
MISS = 4e-9

_WORD = "[^a-z0-9\\x{80}-\\x{10FFFF}]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _WORD), lambda x: x != "")


def _k(length: Column, k: int) -> Column:
    """Words of a shingle of a template of length words."""
    return F.least(length, F.lit(k))


def _shingles(words: Column, k: Column) -> Column:
    """The distinct k-word shingles of an array of at least k words."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.array_join(F.slice(words, i, k), " ")))


def _needed(total: int, length: int, k: int, percent: int) -> int:
    """Bands for a template of length words and total distinct shingles: a window has at
    most 2 * length + 1 - k of them, k the words of a shingle."""
    found = max(1, -(-total * percent // 100))
    alike = found / (total + max(2 * length + 1 - k, found) - found)
    return 1 if alike >= 1 else math.ceil(math.log(MISS) / math.log(1 - alike))


def _bands(shingles: Column, bands: Column) -> Column:
    """The smallest hash of a set for each of the seeds."""
    return F.transform(F.sequence(F.lit(0), bands - 1), lambda b: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, b))))


def _windows(size: Column, length: int) -> Column:
    """Starts of windows of 2 * length words, at every length-th, over size words."""
    last = F.greatest(F.lit(0), F.floor((size - 1) / length).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.lit(length).alias("length"), (i * length).alias("start")))


def _anchors(templates: list[list[str]], percent: int) -> list[str]:
    """Long words such that a window with the asked share of any template's shingles holds
    one of them: few, and the same for many templates where they can be."""
    chosen: list[str] = []
    for shingles in sorted(templates, key=len):
        words = sorted({w for s in shingles for w in s.split()}, key=lambda w: (-len(w), w))
        held = lambda w, left: sum(w in s for s in left)
        left = [s for s in shingles if not any(a in s for a in chosen)]
        while 100 * len(left) >= percent * len(shingles):
            chosen.append(best := max(words, key=lambda w: (min(len(w), 7) if held(w, left) else 0, held(w, left))))
            left = [s for s in left if best not in s]
    return chosen


def _any_contains(parts: Column, anchor: str) -> Column:
    return F.exists(parts, lambda x: x.contains(anchor))


def template_table(spark: SparkSession, templates: dict[str, str], k: int) -> DataFrame:
    """license, its number of words and its shingles. A template needs a word."""
    rows = spark.createDataFrame(sorted(templates.items()), "license string, body string")
    rows = rows.withColumn("words", _words(F.col("body"))).withColumn("length", F.size("words"))
    if empty := [r.license for r in rows.where("length < 1").select("license").collect()]:
        raise ValueError(f"templates without words: {empty}")
    return rows.select("license", "length", _shingles(F.col("words"), _k(F.col("length"), k)).alias("shingles"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, k: int = 5, percent: int = 80, bands: int = 48) -> DataFrame:
    """(doc_id, license, n_windows, found, total): each template that docs(doc_id, text)
    hold, in how many windows, and how many of its total shingles the best one has.

    Words are runs of letters, digits and non-ASCII characters in lower case. A window
    counts if 100 * found >= percent * total. Null and empty texts hold none. templates is a bounded list (its text goes into the plan).
    Rows that repeat a doc_id are counted together, those with a null one as well; other
    columns are not read. bands is the least number of bands.
    """
    spark = docs.sparkSession
    known = template_table(spark, templates or TEMPLATES, k)
    anchors = _anchors([r.shingles for r in known.select("shingles").collect()], percent)
    needed: dict[int, int] = {}
    for r in known.select("length", F.size("shingles").alias("total")).collect():
        needed[r.length] = max(bands, needed.get(r.length, 0), _needed(r.total, r.length, min(r.length, k), percent))
    lengths = sorted(needed)
    seeds = F.element_at(F.create_map(*[F.lit(x) for pair in needed.items() for x in pair]), F.col("length"))
    hint = "(?iu)" + "|".join(anchors)
    some = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").rlike(hint))
    some = some.select("doc_id", _words(F.col("text")).alias("words"))
    starts = [_windows(F.size("words"), n) for n in lengths]
    cut = some.select("doc_id", "words", F.explode(F.concat(*starts)).alias("at")).select("doc_id", "at.length", "at.start", F.slice("words", F.col("at.start") + 1, 2 * F.col("at.length")).alias("part"))
    hints = reduce(lambda a, b: a | b, [_any_contains(F.col("part"), a) for a in anchors], F.lit(False))
    size = _k(F.col("length"), k)
    cut = cut.where((F.size("part") >= size) & hints).select("doc_id", "length", "start", _shingles(F.col("part"), size).alias("shingles"))
    keyed = lambda df, *keep: df.select(*keep, "length", "shingles", F.posexplode(_bands(F.col("shingles"), seeds)).alias("band", "least"))
    mine = keyed(known.withColumn("start", F.lit(0)), "license").select("license", "length", F.col("shingles").alias("template"), "band", "least")
    met = keyed(cut, "doc_id", "start").join(F.broadcast(mine), ["length", "band", "least"])
    found = F.size(F.array_intersect("shingles", "template"))
    held = met.groupBy("doc_id", "license", "start").agg(F.max(found).alias("found"), F.max(F.size("template")).alias("total")).where(F.col("found") * 100 >= F.col("total") * percent)
    return held.groupBy("doc_id", "license").agg(F.count("*").alias("n_windows"), F.max("found").cast("long").alias("found"), F.max("total").cast("long").alias("total"))
