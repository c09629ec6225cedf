"""License scans in DataFrame operations only.

Texts are read as word shingles; of them only those that occur in some template are followed. They fall into overlapping windows, per
template length class twice as long as the class and one class length apart, so every passage of a template's length lies in
one window whole. MinHash bands of the windows retrieve templates; the exact containment of the template's shingles in the window
then decides.

A window that contains ``PERCENT`` of a template has a similarity with it of at least ``LEAST`` (a template of n shingles, n more than half of the class, at
least 0.75 n of them shared, a window of no more than 4 n). With bands of one value and ``BANDS`` bands such a window is missed with a probability below 1e-4.

Scale: one narrow pass over the texts; the templates are a fixed list, so what is broadcast is bounded; only hits are shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WIDTH = 5
PERCENT = 75
LEAST = 0.15
BANDS = math.ceil(math.log(1e-4) / math.log(1 - LEAST))

# Notices by which public licenses are granted or named.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."),
)


def _shingles(text: Column) -> Column:
    """Hashes of the runs of ``WIDTH`` words of a text, in order; null for fewer words."""
    split = F.split(F.trim(F.lower(text), F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+")
    # bound by an outer lambda: an inner one would split the text again for every word
    return F.transform(F.array(split), lambda words: F.when(F.size(words) >= WIDTH, F.transform(
        F.sequence(F.lit(1), F.size(words) - WIDTH + 1), lambda i: F.xxhash64(F.slice(words, i, WIDTH)))))[0]


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(template, license, shingles, n, span): ``span`` is the length class, the power of two from n on. Templates of less
    than ``WIDTH`` words are left out."""
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(name).alias("license"), F.lit(text).alias("text")) for i, (name, text) in enumerate(templates)])
    t = spark.range(1).select(F.inline(rows)).where(F.size(F.split("text", r"\s+")) >= WIDTH)
    t = t.withColumn("shingles", F.array_distinct(_shingles(F.col("text")))).withColumn("n", F.size("shingles"))
    return t.withColumn("span", F.pow(F.lit(2), F.ceil(F.log2("n"))).cast("long")).drop("text")


def _bands(shingle: Column | str) -> list[Column]:
    """A band is the least hash of one seed over a set of shingles."""
    return [F.min(F.xxhash64(F.lit(j), shingle)).alias(f"b{j}") for j in range(BANDS)]


def _band_rows(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode(F.array(*[f"b{j}" for j in range(BANDS)])).alias("band", "value"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """(``id_col``, license, first_word, containment) of every document and license found in it.

    containment: the largest share of a template's shingles within one window, from ``percent`` / 100 on; first_word: the place, from 0, of
    the earliest shingle of such windows. Null and empty texts and those of less than five words have no row, nor has an empty table.
    Rows that repeat an id are scanned each and reported together; a null id is reported as null. Other columns are ignored.
    """
    known = template_table(docs.sparkSession, templates)
    followed = F.broadcast(known.select(F.explode("shingles").alias("shingle")).distinct())
    spans = F.broadcast(known.select(F.explode("shingles").alias("shingle"), "span").distinct())
    text = F.col(text_col).cast("string")
    rows = docs.where(text.isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("row"), F.posexplode(_shingles(text)).alias("at", "shingle"))
    hits = rows.join(followed, "shingle")
    at = F.floor(F.col("at") / F.col("span"))
    placed = hits.join(spans, "shingle").select("id", "row", "at", "shingle", "span", F.explode(F.when(at > 0, F.array(at - 1, at)).otherwise(F.array(at))).alias("window"))
    windows = placed.groupBy("id", "row", "span", "window").agg(F.collect_set("shingle").alias("held"), F.min("at").alias("first"), *_bands("shingle"))
    marked = F.broadcast(_band_rows(known.select("template", "span", F.explode("shingles").alias("shingle")).groupBy("template", "span").agg(*_bands("shingle")), "template", "span"))
    found = _band_rows(windows, "id", "row", "span", "window", "held", "first").join(marked, ["span", "band", "value"]).select(
        "id", "row", "span", "window", "held", "first", "template").distinct()
    shared = F.size(F.array_intersect("held", "shingles"))
    sure = found.join(F.broadcast(known.drop("span")), "template").where(100 * shared >= percent * F.col("n")).withColumn("part", shared / F.col("n"))
    return sure.groupBy(F.col("id").alias(id_col), "license").agg(F.min("first").cast("long").alias("first_word"), F.max("part").alias("containment"))
