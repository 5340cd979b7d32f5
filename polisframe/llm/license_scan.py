"""License scan by MinHash bands over overlapping text windows, all in Spark's own functions.

Texts and templates are sets of five-word shingles (letters and digits, lower case); a template of fewer words is one shingle of all
its words, and shingles of as many words stand for the text. For every template size there are windows
of as many consecutive shingles, one at each word. A window with a containment of at least 0.8 has a Jaccard likeness of at
least 2/3 with its template, and 12 bands of 2 rows then collide with a probability of 1 - (1 - 4/9)^12 > 0.999, exact
copies always. Retrieved pairs are verified by exact shingle containment.

A window can only share a band with a template if it holds shingles that are minima of the template, so signatures
are made just for windows around such shingles; the minima are a short fixed list. Nothing is shuffled but the verified matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polisframe.llm._shared import text_column

SHINGLE, BANDS, ROWS, CONTAINMENT = 5, 12, 2, 0.8

#: Notices in the licenses' own public wording.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Released under the MIT License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("apache-2.0-notice", "You may not use this file except in compliance with the License."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("gpl-grant", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

#: What the query looks for: with a notice of three words.
NOTICES = (*TEMPLATES, ("all-rights-reserved", "All rights reserved."))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(words: Column) -> Column:
    """The hash of the shingle at each word; the last four of a text are of fewer words and match none."""
    return F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, SHINGLE)]))


def _short(words: Column, start: Column, width: int) -> Column:
    """The hash of the shingle of ``width`` words, fewer than five, at a word; unlike that of any other width."""
    return F.xxhash64(F.lit(width), *[F.get(words, start + j) for j in range(width)])


def _order(j: int) -> Callable[[Column], Column]:
    """The j-th order of shingles."""
    return lambda h: F.xxhash64(h, F.lit(j))


def _least(shingles: Column, j: int) -> Column:
    """The shingle that comes first in the j-th order."""
    placed = F.transform(shingles, lambda h: F.struct(_order(j)(h).alias("o"), h.alias("h")))
    return F.array_min(placed)["h"]


def _starts(hits: Column, size: int, minima: list[int], highest: Column) -> Column:
    """(start, size) of the windows of ``size`` shingles around those in ``minima``."""
    own = F.filter(hits, lambda x: x["h"].isin(minima))
    around = F.flatten(F.transform(own, lambda x: F.sequence(F.greatest(x["i"] - (size - 1), F.lit(0)), x["i"])))
    inside = F.array_distinct(F.filter(around, lambda s: s <= highest))
    return F.transform(inside, lambda s: F.struct(s.alias("start"), F.lit(size).alias("size")))


def _places(words: Column, width: int, hashes: list[int]) -> Column:
    """(start, size) of the shingles of ``width`` words that are whole templates."""
    placed = F.transform(words, lambda w, i: F.struct(i.alias("start"), _short(words, i, width).alias("h")))
    return F.transform(F.filter(placed, lambda x: x["h"].isin(hashes)), lambda x: F.struct(x["start"].alias("start"), F.lit(1).alias("size")))


def _window(width: int) -> Callable[[Column], Column]:
    return lambda w: F.struct(w["start"].alias("start"), w["size"].alias("size"), F.lit(width).alias("width"))


def _minima(shingles: Column) -> list[Column]:
    return [F.array_min(F.transform(shingles, _order(j))) for j in range(BANDS * ROWS)]


def _bands(minima: list[Column]) -> Column:
    return F.array(*[F.xxhash64(*minima[ROWS * b:ROWS * (b + 1)], F.lit(b)) for b in range(BANDS)])


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row: filters on it stay above, instead of computing it anew inside lambdas."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _templates(docs: DataFrame, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    """(license_id, shingles, size, width) of the fixed table; ``width``: words of a shingle."""
    values = F.array(*[F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("text")) for i, t in templates])
    rows = docs.sparkSession.range(1).select(F.inline(values)).withColumn("words", _words(F.col("text")))
    rows = rows.withColumn("width", F.least(F.size("words"), F.lit(SHINGLE))).where("width > 0")
    long = F.array_distinct(F.slice(_shingles(F.col("words")), 1, F.greatest(F.size("words") - (SHINGLE - 1), F.lit(0))))
    shingles = F.when(F.col("width") == SHINGLE, long)
    for width in range(1, SHINGLE):
        shingles = shingles.when(F.col("width") == width, F.array(_short(F.col("words"), F.lit(0), width)))
    return rows.withColumn("shingles", shingles).select("license_id", "shingles", F.size("shingles").alias("size"), "width")


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = NOTICES, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license_id, windows, best, first_word): the templates that each document of ``docs`` (doc_id, text) holds.

    ``windows``: windows that contain at least ``containment`` of the template's shingles (a text shorter than the
    template is one window), ``best``: the largest containment, ``first_word``: where the first such window begins. Documents without a match,
    null and empty texts have no row; rows of one id, or without id, are put together; other columns are ignored.
    A template of fewer than five words is one shingle and matches as a whole; one without words matches nothing.
    """
    known = _templates(docs, templates)
    chosen = F.array(*[_least(F.col("shingles"), j) for j in range(BANDS * ROWS)])
    listed = known.groupBy("size", "width").agg(F.array_distinct(F.flatten(F.collect_set(chosen))).alias("minima")).collect()  # a row per template size
    by_size = {r["size"]: list(r["minima"]) for r in listed if r["width"] == SHINGLE}
    by_width = {r["width"]: list(r["minima"]) for r in listed if r["width"] < SHINGLE}
    every = sorted({h for m in by_size.values() for h in m})
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_column().alias("text"))
    words = _once(rows, "words", _words(F.col("text"))).select("doc_id", "words")
    hashed = _once(words, "h", _shingles(F.col("words")))
    found = _once(hashed, "hits", F.filter(F.transform("h", lambda h, i: F.struct(i.alias("i"), h.alias("h"))), lambda x: x["h"].isin(every)))
    last = F.greatest(F.size("h") - (SHINGLE - 1), F.lit(1))
    starts = [F.transform(_starts(F.col("hits"), size, minima, F.greatest(last - size, F.lit(0))), _window(SHINGLE)) for size, minima in sorted(by_size.items())]
    for width, hashes in sorted(by_width.items()):
        found = _once(found, f"at{width}", _places(F.col("words"), width, hashes))
        starts.append(F.transform(f"at{width}", _window(width)))
    windows = found.select("doc_id", "words", "h", F.explode(F.flatten(F.array(*starts))).alias("w")) if starts else found.select(
        "doc_id", "words", "h", F.struct(F.lit(0).alias("start"), F.lit(0).alias("size"), F.lit(0).alias("width")).alias("w")).where(F.lit(False))
    part = F.when(F.col("w.width") == SHINGLE, F.array_distinct(F.slice("h", F.col("w.start") + 1, F.col("w.size"))))
    for width in sorted(by_width):
        part = part.when(F.col("w.width") == width, F.array(_short(F.col("words"), F.col("w.start"), width)))
    windows = _once(windows, "part", part).select("doc_id", F.col("w.start").alias("start"), F.col("w.size").alias("size"), "part")
    signed = _once(windows, "m", F.array(*_minima(F.col("part"))))
    signed = signed.select("doc_id", "start", "size", "part", F.explode(_bands([F.col("m")[j] for j in range(BANDS * ROWS)])).alias("band"))
    model = known.select("license_id", "shingles", F.col("size").alias("of"), F.array(*_minima(F.col("shingles"))).alias("m")).select(
        "license_id", "shingles", "of", F.explode(_bands([F.col("m")[j] for j in range(BANDS * ROWS)])).alias("band"))
    pairs = signed.join(F.broadcast(model), "band").where("size = of")  # as many rows as templates times bands
    share = F.size(F.array_intersect("part", "shingles")) / F.col("of")
    verified = pairs.select("doc_id", "license_id", "start", share.alias("share")).where(F.col("share") >= containment)
    once = verified.groupBy("doc_id", "license_id", "start").agg(F.max("share").alias("share"))
    return once.groupBy("doc_id", "license_id").agg(F.count("*").alias("windows"), F.max("share").alias("best"),
                                                    F.min("start").cast("bigint").alias("first_word"))
