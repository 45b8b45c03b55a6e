"""License scans: TF-IDF cosine of headers and licence files to templates, then inheritance down the folders."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtally.operators.sized import small_side
from flowtally.session import settled

# Usual notices of common licences.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
}
#: A line with one of these starts a header; each template has one, though not on its first line once it is wrapped.
CUES = r"(?i)licen[cs]|permission|redistribut|copyright|spdx"
#: Lines of a header that are compared as one, from a line with a cue on.
HEIGHTS = (1, 4, 12)
#: Base names of licence files: their whole text is compared too, and their folder's files inherit.
FILE_NAMES = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)(\.[a-z]+)?$"
LEAST = 0.6


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def template_table(spark: SparkSession, templates: dict[str, tuple[str, ...]]) -> DataFrame:
    rows = [(f"{name}/{i}", name, text) for name, texts in templates.items() for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "template string, license string, text string")


def term_weights(files: DataFrame, vocabulary: list[str]) -> tuple[DataFrame, float]:
    """Weights ln((1 + n) / (1 + df)) + 1 of the templates' terms over all whole texts, and the weight of a term
    outside of them, that of df 0. The vocabulary is as large as the templates are, whatever the files."""
    n = files.count()
    known = F.array(*[F.lit(x) for x in vocabulary])
    held = files.select(F.explode(F.array_intersect(terms(F.col("text")), known)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    words = files.sparkSession.createDataFrame([(x,) for x in vocabulary], "term string")
    weight = (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.coalesce("df", F.lit(0)))) + 1).alias("weight")
    top = files.sparkSession.range(1).select((F.log(F.lit(1.0) + n) + 1).alias("w")).first()["w"]
    return F.broadcast(words.join(held, "term", "left").select("term", weight)), top


def _vectors(units: DataFrame, key: list[str], weights: DataFrame, other: float) -> DataFrame:
    """key, term, value of each unit's text, scaled to length 1; terms outside the templates only count in the length."""
    counts = units.select(*key, F.explode(terms(F.col("text"))).alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))
    valued = counts.join(weights, "term", "left").withColumn("value", F.col("tf") * F.coalesce("weight", F.lit(other)))
    norms = valued.groupBy(*key).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"),
                                    F.collect_list(F.when(F.col("weight").isNotNull(), F.struct("term", "value"))).alias("held"))
    return norms.select(*key, F.explode("held").alias("x"), "norm").select(*key, "x.term", (F.col("x.value") / F.col("norm")).alias("value"))


def _anchors(templates: list[list[str]]) -> dict[str, list[tuple[int, int]]]:
    """For each cue word of the templates, given as their terms: (terms before it, terms in all) of its places."""
    found: dict[str, set[tuple[int, int]]] = {}
    for ts in templates:
        for i, w in enumerate(ts):
            if re.search(CUES, w):
                found.setdefault(w, set()).add((i, len(ts)))
    return {w: sorted(x) for w, x in sorted(found.items())}


def _word_windows(named: DataFrame, anchors: dict[str, list[tuple[int, int]]]) -> DataFrame:
    """key, found, unit, text: around each cue word of a file the terms that a template with that word there would
    take up, however its lines are wrapped."""
    known = F.create_map(*[x for w, places in anchors.items()
                           for x in (F.lit(w), F.array(*[F.struct(F.lit(b).alias("before"), F.lit(n).alias("n")) for b, n in places]))])
    files = named.where(F.col("text").rlike(CUES)).select("key", terms(F.col("text")).alias("ws"))
    cues = F.filter(F.transform("ws", lambda w, i: F.when(w.isin(list(anchors)), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull())

    def around(x: Column) -> Column:
        return F.transform(F.element_at(known, x["w"]), lambda a: F.struct(
            F.greatest(x["i"] - a["before"], F.lit(0)).alias("first"), (x["i"] - a["before"] + a["n"]).alias("end")))

    windows = F.array_distinct(F.flatten(F.transform("cues", around)))
    cut = F.transform(windows, lambda v: F.struct(v["first"].alias("first"), v["end"].alias("end"), F.array_join(F.slice("ws", v["first"] + 1, v["end"] - v["first"]), " ").alias("text")))
    return (files.withColumn("cues", cues).where(F.size("cues") > 0).select("key", F.explode(cut).alias("v"))
            .select("key", F.lit("header").alias("found"), F.concat(F.lit("words/"), "v.first", F.lit("/"), "v.end").alias("unit"), "v.text"))


def folder(path: Column) -> Column:
    """The folder of a path, empty at the top."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def scan_licenses(files: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, least: float = LEAST) -> DataFrame:
    """Licence of each file. ``files``: id, path, text; the result has one row for each row:
    id, path, license, score, found (header, file, inherited or null), source (path of the file it comes from).

    Headers are the lines with a cue word and the 3 and 11 lines behind, and around each cue word as many words
    before and behind it as each template has, anywhere in the whole text; files with the name of a licence file
    are compared as wholes too. The best cosine of at least ``least`` counts, ties go
    to the licence that sorts first. A file without one takes the licence of the licence file in the nearest
    folder above it (several in one folder: the best score, then the first path). Null texts are empty, null
    paths lie in no folder, rows equal in id, path and text get the same result. The common folders are
    inherited once for each folder, not for each file.
    """
    spark = files.sparkSession
    wanted = template_table(spark, TEMPLATES if templates is None else templates)
    spelled = [r["w"] for r in wanted.select(terms(F.col("text")).alias("w")).collect()]
    vocabulary = sorted({w for ws in spelled for w in ws})
    anchors = _anchors(spelled)
    texts = files.select("id", "path", F.coalesce("text", F.lit("")).alias("text"))
    weights, other = term_weights(texts, vocabulary)
    weights = F.broadcast(settled(weights, "terms"))
    targets = F.broadcast(_vectors(wanted, ["template", "license"], weights, other).withColumnRenamed("value", "t_value"))

    key = F.xxhash64("id", "path", "text").alias("key")
    named = texts.select("id", "path", "text", key)
    lines = named.where(F.col("text").rlike(CUES)).select("key", F.split("text", "\n").alias("lines"), F.lit("header").alias("found"))
    starts = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(CUES), i + 1)), lambda i: i.isNotNull())
    headers = (lines.select("key", "lines", "found", F.explode(starts).alias("start"))
               .select("key", "found", "start", F.explode(F.array(*[F.struct(F.lit(h).alias("height"), F.array_join(F.slice("lines", F.col("start"), h), "\n").alias("text")) for h in HEIGHTS])).alias("u"))
               .select("key", "found", F.concat("start", F.lit("/"), "u.height").alias("unit"), "u.text"))
    wholes = named.where(F.col("path").rlike(FILE_NAMES)).select("key", F.lit("file").alias("found"), F.lit("all").alias("unit"), "text")
    units = headers.unionByName(wholes)
    if anchors:
        units = units.unionByName(_word_windows(named, anchors))
    units = units.dropDuplicates(["key", "unit"])
    scored = (_vectors(units, ["key", "unit"], weights, other).join(targets, "term")
              .groupBy("key", "unit", "template", "license").agg(F.round(F.sum(F.col("value") * F.col("t_value")), 6).alias("score"))
              .where(F.col("score") >= least))
    kind = F.when(F.col("unit") == "all", F.lit("file")).otherwise(F.lit("header"))
    best = scored.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("neg"), "license", kind.alias("found"))).alias("best"))
    judged = settled(named.drop("text").join(best, "key", "left"), "licenses")

    holders = (judged.where(F.col("path").rlike(FILE_NAMES) & F.col("best").isNotNull())
               .groupBy(folder(F.col("path")).alias("above")).agg(F.min(F.struct("best.neg", "path", "best.license")).alias("holder")))
    holders, _ = small_side(holders)
    bare = judged.where("best IS NULL AND path IS NOT NULL").select(folder(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    chain = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    given = (bare.select("dir", F.posexplode(F.array_distinct(chain)).alias("depth", "above")).join(holders, "above")
             .groupBy("dir").agg(F.max_by("holder", "depth").alias("holder")))
    given, _ = small_side(given)
    own = F.col("best").isNotNull()
    return (judged.withColumn("dir", F.when(~own, folder(F.col("path")))).join(given, "dir", "left")
            .select("id", "path", F.when(own, F.col("best.license")).otherwise(F.col("holder.license")).alias("license"),
                    F.when(own, -F.col("best.neg")).otherwise(-F.col("holder.neg")).alias("score"),
                    F.when(own, F.col("best.found")).when(F.col("holder").isNotNull(), F.lit("inherited")).alias("found"),
                    F.when(own, F.col("path")).otherwise(F.col("holder.path")).alias("source")))
