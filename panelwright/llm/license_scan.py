"""Licence notices found by Dice similarity over word bigrams (operator 1, native).

A text is cut into units: sentences, lines and the text as a whole. A unit and a template are normalised
(lower case, letters and digits only) and compared as sets of word bigrams a and b by
``2 |a & b| / (|a| + |b|)``. A score of at least t needs ``t / (2 - t) <= |a| / |b| <= (2 - t) / t``, so a
unit outside the bounds of every template is dropped before its bigrams are formed, and the others only
meet templates within their bounds. The bigrams of a unit find templates by a hash join on the bigram.

A notice may also be wrapped over lines or stand inside a longer text, where none of these units is the
notice. So every run of words that begins and ends with a bigram of a template, and is no longer than the
template's upper bound, is compared as well (a window; other ends only lower the score). A match shares at
least ``t / (2 - t)`` of the template's bigrams, so a text must hold one of a few words of the template.

Scale: templates are a fixed list (some hundred bigrams), so the join needs no shuffle of the corpus. Only
bigrams that occur in a template within the bounds are shuffled, counted per (document, unit, template).
Windows are formed in the row of their text; only those that reach the threshold are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from panelwright.session import durable

THRESHOLD = 0.8

# Wording of public licence notices.
TEMPLATES = {
    "apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "mit notice": "Released under the MIT License.",
    "mit grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "gpl-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-2.1 notice": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "mpl-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "bsd clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "isc grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by-nc-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0 notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "all rights reserved": "Copyright. All rights reserved.",
}
WHOLE_BELOW = 4  # key words shorter than this must stand alone
SENTENCE_END = r"\n+|(?<=[.!?])\s+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), "")


def _bigrams(words: Column) -> Column:
    """Distinct word pairs; a single word stands for itself, so one-word units and templates still compare."""
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.when(F.size(words) > 1, pairs).otherwise(words))


def _templates(spark, templates: dict[str, str], threshold: float) -> tuple[DataFrame, list[Row]]:
    texts = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).alias("wording")) for k, v in sorted(templates.items())])
    frame = spark.range(1).select(F.explode(texts).alias("t")).select("t.*").select("license", _bigrams(_words(F.col("wording"))).alias("b"))
    frame = frame.select("license", "b", F.size("b").alias("t_size"), F.ceil(F.size("b") * threshold / (2 - threshold) - 1e-9).alias("low"), F.floor(F.size("b") * (2 - threshold) / threshold + 1e-9).alias("high"))
    return frame.select("license", "t_size", "low", "high", F.explode("b").alias("bigram")), frame.where("t_size > 0").collect()


def _keys(template: Row) -> list[str]:
    """Words of which a match holds at least one: fewer than ``low`` of the template's bigrams have none of them."""
    keys, left = [], [b.split(" ") for b in template["b"]]
    while len(left) >= template["low"]:
        keys.append(max((w for b in left for w in b), key=lambda w: (len(w), w)))
        left = [b for b in left if keys[-1] not in b]
    return keys


def _holding_keys(docs: DataFrame, text: Column, templates: list[Row]) -> DataFrame:
    """``id, text, lower`` of the texts that hold a key word of any template; no other text can match one."""
    keys = sorted({k for t in templates for k in _keys(t)})
    keys = [k for k in keys if not any(o != k and o in k and len(o) >= WHOLE_BELOW for o in keys)]
    rows = docs.where(text.isNotNull()).select("id", "text", F.explode(F.array(F.lower(text))).alias("lower"))

    def holds(key: str) -> Column:
        found = F.contains("lower", F.lit(key))
        # Short words also stand inside many others; those are told apart where the quick test finds something.
        return found if len(key) >= WHOLE_BELOW else found & F.rlike("lower", F.lit(rf"(?<![\p{{L}}\p{{N}}]){key}(?![\p{{L}}\p{{N}}])"))

    return rows.where(reduce(lambda a, b: a | b, map(holds, keys)))


def _windows(rows: DataFrame, templates: list[Row], threshold: float) -> DataFrame:
    """``id, license, dice, n_windows``: best window, and how many different ones match at places of their own."""
    barrier = lambda x: F.explode(F.array(x))
    fixed = F.array(*[
        F.struct(F.lit(t["license"]).alias("license"), F.lit(t["t_size"]).alias("t_size"), F.lit(int(t["low"])).alias("low"), F.lit(int(t["high"])).alias("high"), F.array(*map(F.lit, _keys(t))).alias("keys"), F.array(*map(F.lit, t["b"])).alias("b"))
        for t in templates
    ])
    rows = rows.select("id", F.xxhash64("text").alias("key"), F.filter(fixed, lambda t: F.exists(t["keys"], lambda k: F.contains("text", k))).alias("t"), barrier(_words(F.col("text"))).alias("words"))
    pairs = F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    rows = rows.where(F.size("words") > 0).select("id", "key", "t", barrier(F.when(F.size("words") > 1, pairs).otherwise(F.col("words"))).alias("b"))
    rows = rows.select("id", "key", "b", F.explode("t").alias("t"))
    rows = rows.select("id", "key", "b", "t", barrier(F.filter(F.sequence(F.lit(1), F.size("b")), lambda i: F.array_contains(F.col("t.b"), F.get("b", i - 1)))).alias("hits"))
    enough = F.filter(F.sequence(F.lit(0), F.size("hits")), lambda j: F.get("hits", j + F.col("t.low") - 1) - F.get("hits", j) < F.col("t.high"))
    rows = rows.select("id", "key", "t", F.explode(F.transform(enough, lambda j: F.struct(F.get("hits", j).alias("at"), F.slice("b", F.get("hits", j), F.col("t.high")).alias("b")))).alias("w"))
    ends = F.filter(F.sequence(F.col("t.low"), F.size("w.b")), lambda n: F.array_contains(F.col("t.b"), F.get("w.b", n - 1)))

    def score(n: Column) -> Column:
        cut = F.slice("w.b", 1, n)
        return F.struct((2 * F.size(F.array_intersect(cut, "t.b")) / (F.size(F.array_distinct(cut)) + F.col("t.t_size"))).alias("dice"), (-n).alias("minus"))

    rows = rows.select("id", "key", "t.license", "w", barrier(F.array_max(F.transform(ends, score))).alias("best")).where(F.col("best.dice") >= threshold)
    rows = rows.select("id", "key", "license", F.struct("w.at", (F.col("w.at") - F.col("best.minus") - 1).alias("end"), "best.dice", F.xxhash64(F.slice("w.b", 1, -F.col("best.minus"))).alias("unit")).alias("w"))
    found = rows.groupBy("id", "license", "key").agg(F.sort_array(F.collect_set("w")).alias("w"))
    none = F.struct(F.lit(-1).cast("int").alias("end"), F.lit(0.0).alias("dice"), F.lit(0).cast("long").alias("unit"), F.array().cast("array<long>").alias("units"))

    def take(seen: Column, w: Column) -> Column:
        own = lambda units: F.struct(w["end"].alias("end"), w["dice"].alias("dice"), w["unit"].alias("unit"), units.alias("units"))
        # Of windows that overlap only the best counts.
        apart = own(F.when(seen["end"] < 0, seen["units"]).otherwise(F.array_append(seen["units"], seen["unit"])))
        return F.when(w["at"] > seen["end"], apart).when(w["dice"] > seen["dice"], own(seen["units"])).otherwise(seen)

    units = F.aggregate("w", none, take, lambda seen: F.array_append(seen["units"], seen["unit"]))
    found = found.select("id", "license", F.array_max(F.transform("w", lambda w: w["dice"])).alias("dice"), units.alias("units"))
    return found.groupBy("id", "license").agg(F.max("dice").alias("dice"), F.size(F.array_distinct(F.flatten(F.collect_list("units")))).alias("n_windows"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and matching template: ``id_col, license, dice, n_units``.

    ``dice`` is the best score of a unit or window, ``n_units`` how many different units reach the threshold; where a
    sentence is a whole line it is one unit. If more different windows than units do, at places that don't
    overlap, ``n_units`` is their number. Documents without a match have no row, nor have null or empty
    texts and empty tables. Rows with the same id and text count once; rows with the same id and different
    texts are one document with the units of both. A null id is an id of its own. Other columns are ignored.
    """
    templates = TEMPLATES if templates is None else templates
    if not templates:
        raise ValueError("templates are empty")
    grams, listed = _templates(docs.sparkSession, templates, threshold)
    if not listed:
        raise ValueError("templates have no words")
    low, high = min(t["low"] for t in listed), max(t["high"] for t in listed)
    # A unit that reaches the threshold holds a key word as well, so texts without one are left out before any split.
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    held = durable(_holding_keys(texts, F.col("text"), listed))  # read twice, and a small part of the corpus
    text = F.col("text")
    cut = F.array_distinct(F.concat(F.split(text, SENTENCE_END), F.split(text, "\n"), F.array(text)))
    # Generators keep the optimizer from writing the word split into each of its uses.
    units = held.select("id", F.explode(F.transform(cut, _words)).alias("words"))
    # There are no more distinct bigrams than words, so the lower bound holds before bigrams are formed.
    units = units.where(F.size("words") >= low)
    sets = units.select("id", F.xxhash64("words").alias("unit"), F.explode(F.array(_bigrams(F.col("words")))).alias("b")).where(F.size("b").between(low, high))
    hits = sets.select("id", "unit", F.size("b").alias("u_size"), F.explode("b").alias("bigram")).join(grams, "bigram").where(F.col("u_size").between(F.col("low"), F.col("high")))
    shared = hits.groupBy("id", "unit", "u_size", "license", "t_size").agg(F.count_distinct("bigram").alias("shared"))
    scored = shared.withColumn("dice", 2 * F.col("shared") / (F.col("u_size") + F.col("t_size"))).where(F.col("dice") >= threshold)
    scored = scored.groupBy("id", "license").agg(F.max("dice").alias("dice"), F.count(F.lit(1)).alias("n_units"))
    wrapped = _windows(held.select("id", F.col("lower").alias("text")), listed, threshold)
    both = scored.unionByName(wrapped.withColumnRenamed("n_windows", "n_units"))
    return both.groupBy(F.col("id").alias(id_col), "license").agg(F.max("dice").alias("dice"), F.max("n_units").alias("n_units"))
