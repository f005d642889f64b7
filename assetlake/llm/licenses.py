"""Licence notices in documents: MinHash bands retrieve templates, exact containment verifies them.

A text's five-word shingles are hashed. For each size n of a template the shingles are covered by windows
of 2n at every n-th place, so that a notice lies whole inside one window. A window and a template
are compared by ``BANDS`` MinHash values of one row each: a notice that keeps at least 80 % of the
template has a similarity above 0.36 with its window, so all bands miss it with probability below
0.64 ** 32 < 10 ** -6. A window without any shingle of any template shares no MinHash value with a
template, so such windows are not built. Every retrieved pair is verified: the window, with n shingles before and after it,
must hold 80 % of the template's shingles.

Templates are a bounded list (at most ``MOST_SHINGLES`` shingles, checked), so their bands are broadcast.

A template under five words has one shingle as wide as itself. None of the default ``TEMPLATES`` is that short, so the
bare notice "All rights reserved." is found only when it is given as a template.

Defined cases: null and empty texts and texts shorter than every template's shingles hold no notice; templates without words are
refused; rows that share id and text have the same result each; rows that share only the id do not mix.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake.llm.columns import alnum_words, computed, shingle_hashes

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 32
MOST_SHINGLES = 20_000

# Usual notices, word by word.
TEMPLATES = {
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-later": "either version 3 of the License, or (at your option) any later version",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "All-rights-reserved": "Copyright holders. All rights reserved. No part of this work may be reproduced",
    "Rights-reserved": "All rights reserved.",
}


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES.items()), "template_id string, text string")


def _minhashes(shingles: Column) -> Column:
    """One value for each band: the least hash, under a permutation of its own, with the band's number."""
    seeds = F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda j: F.struct(j.alias("band"), F.xxhash64(j).alias("seed")))
    return F.transform(
        seeds, lambda s: F.struct(s["band"].alias("band"), F.array_min(F.transform(shingles, lambda h: h.bitwiseXOR(s["seed"]))).alias("low"))
    )


def _verified(docs: DataFrame, hashed: DataFrame, known: list, width: int) -> DataFrame:
    """(doc_id, text_hash, template_id) of the templates found whose shingles have ``width`` words."""
    sizes = sorted({r["n"] for r in known})
    wanted = sorted({h for r in known for h in r["shingles"]})
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), computed(alnum_words(F.col("text"))).alias("words"))
    texts = texts.select("doc_id", "text_hash", computed(shingle_hashes(F.col("words"), width)).alias("hashes"))
    places = F.filter(F.transform("hashes", lambda h, i: F.when(h.isin(wanted), i)), lambda i: i.isNotNull())
    texts = texts.select("*", computed(places).alias("places")).where(F.size("places") > 0)
    sized = texts.select("*", F.explode(F.array(*[F.lit(n) for n in sizes])).alias("n"))
    # A shingle at place p lies in the windows p / n and p / n - 1.
    near = F.array_distinct(F.flatten(F.transform(
        "places", lambda p: F.array(F.floor(p / F.col("n")), F.greatest(F.floor(p / F.col("n")) - 1, F.lit(0).cast("long")))
    )))
    windows = sized.select("doc_id", "text_hash", "hashes", "n", F.explode(near).alias("window")).withColumn("window", F.col("window").cast("int"))
    start = F.col("window") * F.col("n")
    before = F.greatest(start - F.col("n"), F.lit(0))
    parts = windows.select(
        "doc_id", "text_hash", "n", F.slice("hashes", start + 1, 2 * F.col("n")).alias("held"),
        F.slice("hashes", before + 1, start - before + 3 * F.col("n")).alias("around"),
    ).where(F.size("held") > 0)
    keys = parts.select("doc_id", "text_hash", "n", "around", F.explode(_minhashes(F.col("held"))).alias("key"))
    bands = hashed.select("template_id", "shingles", F.size("shingles").alias("n"), F.explode(_minhashes(F.col("shingles"))).alias("key"))
    flat = lambda df, *more: df.select("n", F.col("key.band").alias("band"), F.col("key.low").alias("low"), *more)
    pairs = flat(keys, "doc_id", "text_hash", "around").join(
        F.broadcast(flat(bands, "template_id", "shingles")), ["n", "band", "low"]  # BANDS rows a template
    )
    return pairs.where(F.size(F.array_intersect("shingles", "around")) >= CONTAINMENT * F.col("n")).select("doc_id", "text_hash", "template_id")


def scan_licenses(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """For every row: doc_id, n_licenses and licenses (template ids in order, comma-joined)."""
    spark = docs.sparkSession
    templates = default_templates(spark) if templates is None else templates
    cut = templates.select("template_id", computed(alnum_words(F.col("text"))).alias("words"))
    cut = cut.withColumn("width", F.least(F.size("words"), F.lit(SHINGLE)))
    hashed = cut.select("template_id", "width", F.array_distinct(shingle_hashes(F.col("words"), F.col("width"))).alias("shingles"))
    known = hashed.withColumn("n", F.size("shingles")).limit(MOST_SHINGLES + 1).collect()  # the list is bounded
    if any(not r["width"] for r in known):
        raise ValueError("a template needs words")
    if sum(r["n"] for r in known) > MOST_SHINGLES:
        raise ValueError(f"the templates have more than {MOST_SHINGLES} shingles")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"))
    verified = [_verified(docs, hashed.where(F.col("width") == w), [r for r in known if r["width"] == w], w) for w in sorted({r["width"] for r in known})]
    verified = reduce(DataFrame.unionAll, verified) if verified else rows.select("doc_id", "text_hash", F.lit("").alias("template_id")).limit(0)
    found = verified.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("template_id")).alias("ids"))
    same = rows["doc_id"].eqNullSafe(found["doc_id"]) & (rows["text_hash"] == found["text_hash"])
    ids = F.coalesce("ids", F.array())
    return rows.join(found, same, "left").select(
        rows["doc_id"], F.size(ids).cast("long").alias("n_licenses"), F.concat_ws(",", ids).alias("licenses")
    )
