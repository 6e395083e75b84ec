"""License templates found in texts, on DataFrame functions alone.

Templates and texts are sequences of word shingles (words: runs of a-z and 0-9 of the
lower-cased text; a template of fewer than SHINGLE words is one shingle). MinHash bands over
overlapping windows retrieve templates, then their shingles are looked up exactly.

Retrieval. A window is ``w`` consecutive shingles; a band's value is the least hash of its
shingles under the band's seed. Templates have a window at every shingle, texts one at every
``step``-th, and a band in which both have the same value retrieves the template there. If
80 % of a template's n shingles lie in a text, m = n - 0.8 n are missing. A changed, lost or added
word costs at least SHINGLE - 1 of them, so some run has R = (n - m) / (m // 4 + 1) shingles in
a row. With w + step - 1 <= R a window of the text lies inside that run whole: it equals a
window of the template and collides in every band with probability 1. Not so where pieces of
the template overlap or change places, since such a break may cost none; what is left there is
the chance of windows that a break cuts into (similarity J), 1 - (1 - J) ^ BANDS each, and of the
runs that are long anyway. In a test of such texts no match is missed.

Verification. A template of n words has a scale s, the first of 6, 9, 14, 21, ... (each half as
much again) that holds it. Its shingles are looked up in the windows of 1.5 s words that start
every s / 2 words and hold a retrieved window, so that a whole copy lies inside some window,
whatever the template's length.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.llm.common import plain_columns

#: Words of a shingle, bands of a window (those of one shingle need one).
SHINGLE, BANDS = 5, 2
#: Runs for which windows are laid out: (w, step) with w + step - 1 shingles each.
RUNS = {1: (1, 1), 2: (1, 2), 4: (2, 3), 8: (4, 5)}

# Names and wordings of license notices.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
    "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "mit-line": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the Software",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
    "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "all-rights-reserved": "All rights reserved.",
}


def words_in(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def scale_of(words: int) -> int:
    """Least of 6, 9, 14, 21, 32, ... that is no smaller."""
    scale = 6
    while scale < words:
        scale += (scale + 1) // 2
    return scale


def shingle_list(words: list[str]) -> list[str]:
    """A template's shingles in order; one with fewer words has its whole sequence."""
    width = min(SHINGLE, len(words))
    return [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]


def shingles_of(words: list[str]) -> list[str]:
    return list(dict.fromkeys(shingle_list(words)))


def sure_run(shingles: int, percent: int) -> int:
    """Shingles in a row that a text has which holds ``percent`` of so many in the template's order; the greatest of RUNS up to that."""
    missing = shingles - -(-shingles * percent // 100)
    run = -(-(shingles - missing) // (missing // (SHINGLE - 1) + 1))
    return max(r for r in RUNS if r <= max(1, run))


def held(column: Column) -> Column:
    """One row per row, holding the value of ``column``: an expression put to many uses is then worked out once."""
    return F.explode(F.array(column))


def shingle_hashes(words: str, width: int) -> Column:
    """Hashes of the ``width`` word hashes from every position on; empty where there are fewer words."""
    at = lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(width)])
    return F.when(F.size(words) >= width, F.transform(F.sequence(F.lit(0), F.size(words) - width), at)).otherwise(F.array().cast("array<bigint>"))


def band_value(shingles: list[Column], band: int) -> Column:
    """Least hash of a window's shingles under a band's seed; a single shingle stands for itself."""
    return F.least(*[F.xxhash64(x, F.lit(len(shingles)), F.lit(band)) for x in shingles]) if len(shingles) > 1 else shingles[0]


def bands_of(w: int) -> range:
    return range(BANDS if w > 1 else 1)


def template_tables(spark: SparkSession, templates: dict[str, str], percent: int) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """(value, license, width, w, scale, shingles): a row per band of every window of the templates; and the steps at which windows (width, w) of texts start."""
    rows, kinds = [], {}
    for name, text in templates.items():
        words = words_in(text)
        width, own = min(SHINGLE, len(words)), shingles_of(words)
        w, step = RUNS[sure_run(len(own), percent)]
        kinds[width, w] = min(step, kinds.get((width, w), step))
        # Word sequences as arrays, hashed by Spark as texts are.
        rows.append({"license": name, "width": width, "w": w, "scale": scale_of(len(words)), "listed": shingle_list(words), "own": own})
    kind = "array<struct<license:string,width:int,w:int,scale:int,listed:array<string>,own:array<string>>>"
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))  # as long as the list of templates

    def hashed(shingle: Column) -> Column:
        words = F.transform(F.split(shingle, " "), lambda x: F.xxhash64(x))
        return F.when(F.size(words) == 1, F.xxhash64(F.get(words, F.lit(0)))).otherwise(combined(words))

    def combined(words: Column) -> Column:
        out = F.lit(None).cast("bigint")
        for n in range(2, SHINGLE + 1):
            out = F.when(F.size(words) == n, F.xxhash64(*[F.get(words, F.lit(i)) for i in range(n)])).otherwise(out)
        return out

    table = table.withColumn("listed", F.transform("listed", hashed)).withColumn("shingles", F.transform("own", hashed)).drop("own")
    starts = table.withColumn("at", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("listed") - F.col("w")))))
    values = []
    for w in sorted({w for _, w in kinds}):
        window = [F.get("listed", F.col("at") + i) for i in range(w)]
        values += [F.when(F.col("w") == w, band_value(window, band)) for band in bands_of(w)]
    banded = starts.withColumn("value", F.explode(F.array(*values))).filter("value is not null")
    return banded.select("value", "license", "width", "w", "scale", "shingles").distinct(), kinds


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Templates of which at least ``percent`` of the shingles lie in one window of a text.

    Returns one row per (``id_col``, license): shared_shingles, the most in any window,
    template_shingles, and first_word, the start of the first such window. Texts without a
    match have no row, long ones are scanned whole. A null or empty text has no words; a template of fewer than SHINGLE
    words must be there whole. Rows that repeat an id are scanned each and reported
    together. Other columns are ignored. No rows give no rows.
    """
    templates = {n: t for n, t in (TEMPLATES if templates is None else templates).items() if words_in(t)}
    spark = docs.sparkSession
    if not templates:
        kind = docs.schema[id_col].dataType.simpleString()
        return spark.createDataFrame([], f"`{id_col}` {kind}, license string, shared_shingles bigint, template_shingles bigint, first_word bigint")
    table, kinds = template_tables(spark, templates, percent)
    rows = plain_columns(docs, (id_col, text_col)).select(F.col(f"`{id_col}`").alias("id"), F.regexp_extract_all(F.lower(text_col), F.lit("[a-z0-9]+"), F.lit(0)).alias("words"))
    hashed = rows.select("id", held(F.transform("words", lambda w: F.xxhash64(w))).alias("wh"))
    widths = sorted({width for width, _ in kinds})
    for width in widths:
        hashed = hashed.withColumn(f"h{width}", held(shingle_hashes("wh", width)))

    def windows_of(width: int, w: int, step: int, band: int) -> Column:
        """(p, value) of every window of a text in one band."""
        h = f"h{width}"
        starts = F.sequence(F.lit(0), F.size(h) - w, F.lit(step))
        value = lambda p: band_value([F.get(F.col(h), p + i) for i in range(w)], band)
        made = F.arrays_zip(starts.alias("p"), F.col(h).alias("value")) if w == step == 1 else F.transform(starts, lambda p: F.struct(p.alias("p"), value(p).alias("value")))
        return F.when(F.size(h) >= w, made).otherwise(F.array().cast("array<struct<p:int,value:bigint>>"))

    every = [windows_of(width, w, step, band) for (width, w), step in sorted(kinds.items()) for band in bands_of(w)]
    # Held first: rows of probes are then made by generated code, which doesn't copy a text's arrays to each.
    probes = hashed.withColumn("probes", held(F.concat(*every))).select("id", *[f"h{width}" for width in widths], F.inline("probes"))
    # The table has a few rows for every shingle of the templates.
    retrieved = probes.join(F.broadcast(table), "value")
    # Starts k * (scale div 2) of the windows that hold the retrieved one.
    step, size = F.expr("scale div 2"), F.expr("scale + scale div 2")
    first = F.greatest(F.lit(0), F.ceil((F.col("p") + F.col("w") - 1 - (size - F.col("width"))) / step)).cast("int")
    windows = retrieved.withColumn("start", F.explode(F.transform(F.sequence(first, F.expr("p div (scale div 2)").cast("int")), lambda k: (k * step).cast("int"))))
    own_shingles = F.lit(None).cast("array<bigint>")
    for width in widths:
        own_shingles = F.when(F.col("width") == width, F.slice(f"h{width}", F.col("start") + 1, (size - width + 1).cast("int"))).otherwise(own_shingles)
    # Exact check of what the bands retrieved; a window met several times is grouped away.
    checked = windows.select(
        "id", "license", "start", F.size("shingles").cast("long").alias("of"), F.size(F.array_intersect(own_shingles, "shingles")).cast("long").alias("shared")
    ).filter(F.col("shared") * 100 >= F.col("of") * percent)
    # A window that bands met several times is one row here.
    best = checked.groupBy("id", "license").agg(F.max(F.struct(F.col("shared"), (-F.col("start")).alias("back"))).alias("best"), F.first("of").alias("of"))
    return best.select(F.col("id").alias(id_col), "license", F.col("best.shared").alias("shared_shingles"), F.col("of").alias("template_shingles"), (-F.col("best.back")).cast("long").alias("first_word"))
