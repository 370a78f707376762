"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

A text is its sequence of words, line breaks or not, so a notice may be wrapped or stand inside a long line. A template of m
words is compared with windows of exactly m words, each laid so that one of the template's anchor words stands where the
template has it. A window is a vector of its words: 1 + ln(occurrences), times ln((texts + 1) / (texts with the word + 1)) + 1 for
words of the templates, counted over all texts, and times 1 for words that no template has. A text's own licence is
that of the template of largest cosine, if it is ``min_cosine`` or more.

So an exact notice always has a window of its own with a cosine of 1, in a file of any length, whether one file in a million has
it or every one: what stands around it is in no window, and the weight of a word is never below 1. A template's anchors are
its heaviest words, until the squared weights of the others come to less than ``min_cosine`` squared: a window without any of them
stays below ``min_cosine``, by Cauchy's inequality.

Texts are files under paths; a file without a licence of its own inherits from the nearest ancestor
directory that has a licence file, and a directory whose licence files disagree takes the best one (largest
cosine, then smallest path). Ancestors are an equi-join on (path prefix), one row a level, so depth is all that
multiplies rows. The number of templates is checked, so sending their words to every task is bounded. Equal windows are
scored once, combined on the map side.

Edge cases: a null text counts as empty and has no licence of its own; a null path is the root's file and inherits
only from the root; repeated rows each come back; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, require, spread_join, stored, text_or_empty

#: Notices by which licences announce themselves, in headers and in licence files, under SPDX identifiers.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0"),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "SPDX-License-Identifier: BSD-3-Clause"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC0-1.0": ("CC0 1.0 Universal public domain dedication.", "SPDX-License-Identifier: CC0-1.0"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "Proprietary": ("Copyright. All rights reserved.", "No part may be reproduced without permission."),
}
MIN_COSINE = 0.8
MAX_TEMPLATES = 1000
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"


def _words(column):
    return F.filter(F.split(F.regexp_replace(F.lower(column), r"\.(\s|$)", " "), r"[^\p{L}\p{N}.]+"), lambda w: w != "")


def template_words(text: str) -> list[str]:
    """What ``_words`` makes of a template."""
    return [w for w in re.split(r"[^\w.]|_", re.sub(r"\.(\s|$)", " ", text.lower())) if w]


def _vectors(notices: list[tuple[int, str, list[str]]], texts: int, df: dict[str, int]) -> list[tuple[int, str, str, float]]:
    """``(notice, license, word, y)``: templates of length 1."""
    out = []
    for n, lic, words in notices:
        x = {w: (1.0 + math.log(words.count(w))) * (math.log((texts + 1.0) / (df.get(w, 0) + 1.0)) + 1.0) for w in dict.fromkeys(words)}
        norm = math.sqrt(sum(v * v for v in x.values()))
        out += [(n, lic, w, v / norm) for w, v in x.items()]
    return out


def anchors(vectors: list[tuple[int, str, str, float]], min_cosine: float) -> dict[int, set[str]]:
    """By notice the words of which a window must have one to reach ``min_cosine``."""
    per: dict[int, list[tuple[float, str]]] = {}
    for n, _, w, y in vectors:
        per.setdefault(n, []).append((y * y, w))
    out: dict[int, set[str]] = {}
    for n, words in per.items():
        left = sum(y for y, _ in words)
        # the weights of a tie are equal, so their words decide
        for y, w in sorted(words, key=lambda x: (round(x[0], 12), x[1]), reverse=True):
            if left < min_cosine**2 - 1e-6:
                break
            out.setdefault(n, set()).add(w)
            left -= y
    return out


def _windows(files: DataFrame, notices: list[tuple[int, str, list[str]]], wanted: dict[int, set[str]]) -> DataFrame:
    """``(file, notice, words)``: every window that an anchor word lays, from one pass over the texts."""
    spark = files.sparkSession
    most = max(len(ws) for _, _, ws in notices)
    laid = [(w, n, off, len(ws)) for n, _, ws in notices for off, w in enumerate(ws) if w in wanted.get(n, ())]
    literals = ", ".join(f"'{w}'" for w in sorted({w for w, *_ in laid}))  # letters, digits and dots
    found = files.select("file", _words(F.col("t")).alias("ws"))
    at = F.expr(f"filter(transform(ws, (w, i) -> if(w in ({literals}), i, -1)), i -> i >= 0)")
    # an anchor with the words around it: no more than the longest template on each side
    near = F.transform(at, lambda i: F.struct(F.get("ws", i).alias("word"), F.least(i, F.lit(most)).alias("at"), F.slice("ws", F.greatest(i - most, F.lit(0)) + 1, F.lit(2 * most)).alias("near")))
    hits = found.select("file", F.inline(near))
    places = spark.createDataFrame(laid, "word string, notice int, off int, m int")
    return hits.join(F.broadcast(places), "word").select("file", "notice", F.slice("near", F.greatest(F.col("at") - F.col("off"), F.lit(0)) + 1, F.col("m")).alias("words"))


def own_licenses(files: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, min_cosine: float = MIN_COSINE) -> DataFrame:
    """``(file, license, cosine)`` of every file that has a licence of its own; ``files`` has ``file``, which rows repeated whole share, and ``t``."""
    spark = files.sparkSession
    templates = TEMPLATES if templates is None else templates
    notices = [(n, lic, template_words(text)) for n, (lic, text) in enumerate((lic, t) for lic in sorted(templates) for t in templates[lic])]
    if len(notices) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates")
    notices = [n for n in notices if n[2]]
    vocabulary = spark.createDataFrame([(w,) for w in sorted({w for _, _, ws in notices for w in ws})], "word string")
    # in how many texts each template word stands, and how many texts there are
    each = files.select(F.explode(F.concat(F.array(F.lit("")), F.array_distinct(_words(F.col("t"))))).alias("word"))
    counted = {r["word"]: r["n"] for r in each.join(F.broadcast(vocabulary.unionByName(spark.createDataFrame([("",)], "word string"))), "word").groupBy("word").agg(F.count("*").alias("n")).collect()}
    total = counted.get("", 0)
    vectors = _vectors(notices, total, counted)
    wanted = anchors(vectors, min_cosine)
    if not wanted:
        return files.select("file", F.lit("").alias("license"), F.lit(0.0).alias("cosine")).where(F.lit(False))
    units = stored(_windows(files, notices, wanted), "windows")
    # equal windows are scored once
    kinds = stored(units.groupBy("notice", "words").agg(F.count("*").alias("n")).withColumn("kind", F.monotonically_increasing_id()), "kinds")
    parts = kinds.select("kind", "notice", F.explode("words").alias("word")).groupBy("kind", "notice", "word").agg(F.count("*").alias("tf"))
    known = spark.createDataFrame(vectors, "notice int, license string, word string, y double")
    idf = spark.createDataFrame([(w, math.log((total + 1.0) / (counted.get(w, 0) + 1.0)) + 1.0) for w in sorted({v[2] for v in vectors})], "word string, idf double")
    weighed = parts.join(F.broadcast(idf), "word", "left").withColumn("x", (F.lit(1.0) + F.log("tf")) * F.coalesce("idf", F.lit(1.0)))
    weighed = weighed.join(F.broadcast(known.drop("license")), ["notice", "word"], "left")
    cosine = F.round(F.sum(F.col("x") * F.coalesce("y", F.lit(0.0))) / F.sqrt(F.sum(F.col("x") * F.col("x"))), 9)
    scored = weighed.groupBy("kind", "notice").agg(cosine.alias("cosine")).where(F.col("cosine") >= min_cosine)
    names = spark.createDataFrame([(n, lic) for n, lic, _ in notices], "notice int, license string")
    best = scored.join(F.broadcast(names), "notice").select("kind", F.struct("cosine", "license").alias("m"))
    named = stored(kinds.join(best, "kind").select("notice", "words", "m", "n"), "named")
    top = spread_join(units, named, ["notice", "words"]).groupBy("file").agg(F.max("m").alias("m"))
    out = stored(top.select("file", F.col("m.license").alias("license"), F.col("m.cosine").alias("cosine")), "own")
    drop_stored(units, kinds, named)
    return out


def directory_licenses(owned: DataFrame) -> DataFrame:
    """``(dir, license)`` from licence files: ``owned`` has ``path``, ``license`` and ``cosine``."""
    files = owned.where(F.col("path").rlike(LICENSE_FILE)).select(F.regexp_replace("path", r"/?[^/]*$", "").alias("dir"), "path", "license", "cosine")
    # the best cosine, then the smallest path
    return files.groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "path", "license")).alias("m")).select("dir", F.col("m.license").alias("license"), F.col("m.path").alias("license_path"))


def ancestors(path):
    """The directories above a path, nearest first, the root (empty) last."""
    parts = F.split(path, "/")
    depth = F.size(parts) - 1
    return F.transform(F.sequence(F.lit(0), depth), lambda i: F.struct(i.alias("up"), F.array_join(F.slice(parts, F.lit(1), depth - i), "/").alias("dir")))


def scan_licenses(files: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, min_cosine: float = MIN_COSINE) -> DataFrame:
    """doc_id, path, license, how (own, inherited or none), cosine and license_path of every row.

    ``files`` has ``doc_id``, ``path`` and ``text``.
    """
    require(files, "doc_id", "path", "text")
    rows = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("path", F.lit("")).alias("path"), text_or_empty(files).alias("t"))
    texts = rows.select(F.unhex(F.sha2(F.concat_ws("\u0001", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "path", "t"), 256)).alias("file"), "doc_id", "path", "t")
    own = own_licenses(texts.select("file", "t"), templates, min_cosine)
    placed = stored(texts.select("file", "doc_id", "path").join(own, "file", "left"), "placed")
    dirs = stored(directory_licenses(placed.where("license is not null").select("path", "license", "cosine")), "dirs")
    # each directory's nearest ancestor with a licence: directories are far fewer than files
    seek = placed.where("license is null").select(F.regexp_replace("path", r"/?[^/]*$", "").alias("at")).distinct()
    up = seek.select("at", F.inline(ancestors(F.concat("at", F.lit("/_")))))
    near = up.join(dirs, "dir").groupBy("at").agg(F.min(F.struct("up", "license", "license_path")).alias("m"))
    near = near.select("at", F.col("m.license").alias("from_license"), F.col("m.license_path").alias("license_path"))
    out = placed.withColumn("at", F.regexp_replace("path", r"/?[^/]*$", "")).join(near, "at", "left")
    lic = F.coalesce("license", "from_license")
    how = F.when(F.col("license").isNotNull(), "own").when(F.col("from_license").isNotNull(), "inherited").otherwise("none")
    return out.select("doc_id", "path", lic.alias("license"), how.alias("how"), "cosine", F.when(F.col("license").isNull(), F.col("license_path")).alias("license_path"))


def document_paths(docs: DataFrame) -> DataFrame:
    """The documents as a tree of files: ``<thousand>/<ten>/<doc_id>.txt``.

    The table has no paths, so they are made from doc_id. Every tenth document is its directory's licence
    file, and every hundredth that of the thousand, so what is found there is inherited by the files below.
    """
    n = F.coalesce(F.col("doc_id"), F.lit(0)).cast("long")
    thousand, ten = F.expr("coalesce(doc_id, 0) div 1000").cast("string"), F.expr("coalesce(doc_id, 0) div 10").cast("string")
    notice = F.concat(F.lit("LICENSE."), n.cast("string"))
    path = F.when(n % 100 == 0, F.concat_ws("/", thousand, notice)).when(n % 10 == 0, F.concat_ws("/", thousand, ten, notice)).otherwise(F.concat_ws("/", thousand, ten, F.concat(n.cast("string"), F.lit(".txt"))))
    return docs.select("doc_id", path.alias("path"), "text")
