"""Licence scans: TF-IDF cosine to licence notices, then inheritance along directories.

Every line of a file, every block of up to ``BLOCK_LINES`` adjacent lines that begins and ends with words, and every file as a
whole is compared with short notices: sentences of headers, and titles and characteristic sentences of licence texts.
Weights are term counts times ``ln((files + 1) / (files with the term + 1)) + 1``, counted over all files; terms
that are in no notice weigh like unseen ones. What reaches ``LEAST_COSINE`` gives its file a licence. A file
speaks for its directory if it reaches it as a whole, or in any part and bears a licence file's name (``NAMES``), as files with the
full text do. A file without licence of its own takes that of the nearest directory above it, its own first, for
which a file speaks. A notice that other licences hold too (``GENERAL``) gives way to any other in the same file or directory.

A line or block can only reach the threshold for a notice if it has one of the notice's rarest terms: the
other terms' weights are too small together. So only those with such a term are looked at closely, and none is lost. Of a
very long text the lines are looked at one by one.

A null text is empty. A null path is in no directory. An empty notice is never matched. Among equal cosines the first
licence by name wins, then the first line. Without files there are no rows. Files repeated whole (path and text) are one file with as many
rows; texts that differ under one path are files of their own. Only the path, the text and the columns
named by ``keep`` are looked at, so other columns may have any name.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from snapfolio.sources.scratch import written

LEAST_COSINE = 0.6
BLOCK_LINES = 4
NAMES = r"(?i)^((un)?licen[cs]e|copying)"
BREAK = r"[^\p{L}\p{N}]+"

#: Short notices as they stand in headers. Fixed values.
NOTICES = [
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "Licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    # Titles and sentences of the licences' own texts.
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]
#: The two clauses are part of the three.
GENERAL = ["BSD-2-Clause"]


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), BREAK), lambda w: w != "")


def notice_terms(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def _table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A few rows as a table, without Python on the executors."""
    names = [c.split()[0] for c in ddl.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    schema = f"array<struct<{', '.join(c.replace(' ', ': ', 1) for c in ddl.split(', '))}>>"
    return spark.range(1).select(F.explode(F.from_json(F.lit(text), schema)).alias("r")).select("r.*")


def _lit_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _weights(files: DataFrame, notices: list[tuple[str, str]]) -> tuple[dict[str, float], float]:
    """The IDF of every term of the notices, and that of any other."""
    vocabulary = sorted({t for _, n in notices for t in notice_terms(n)})
    found = files.select(F.explode(F.array_intersect(terms(F.col("text")), _lit_array(vocabulary))).alias("t"))
    # A row per term of the notices.
    df = {r["t"]: r["n"] for r in found.groupBy("t").agg(F.count("*").alias("n")).collect()}
    n = files.count()
    return {t: math.log((n + 1) / (df.get(t, 0) + 1)) + 1 for t in vocabulary}, math.log(n + 1) + 1


def _vector(notice: str, idf: dict[str, float]) -> dict[str, float]:
    found = notice_terms(notice)
    return {t: found.count(t) * idf[t] for t in found}


def rare_terms(notices: list[tuple[str, str]], idf: dict[str, float], least: float) -> list[str]:
    """Terms one of which a text must have to reach the cosine ``least`` with any notice."""
    out = set()
    for _, notice in notices:
        vector = _vector(notice, idf)
        most = (least - 1e-9) ** 2 * sum(w * w for w in vector.values())
        common = 0.0
        for term in sorted(vector, key=lambda t: (vector[t], t)):
            common += vector[term] ** 2
            if common >= most:
                out.add(term)
    return sorted(out)


def _cosines(parts: DataFrame, notices, idf, other: float, least: float) -> DataFrame:
    """Of rows ``path, h, line, many, words`` the best licence and its cosine, where it reaches ``least``."""
    spark = parts.sparkSession
    known = _table(spark, sorted(idf.items()), "term string, idf double")
    rows = []
    for n, (licence, notice) in enumerate(notices):
        vector = _vector(notice, idf)
        norm = math.sqrt(sum(w * w for w in vector.values()))
        rows += [(t, n, licence, w / norm) for t, w in vector.items()]
    weights = _table(spark, rows, "term string, notice int, licence string, w double")
    keys = ["path", "h", "line", "many"]
    counted = (
        parts.select(*keys, F.explode("words").alias("term"))
        .groupBy(*keys, "term").agg(F.count("*").alias("tf"))
        .join(F.broadcast(known), "term", "left")
    )
    counted = written(counted, "terms")
    # Each term that is in no notice is one of its own.
    square = F.pow(F.col("tf") * F.coalesce("idf", F.lit(other)), 2)
    norms = counted.groupBy(*keys).agg(F.sqrt(F.sum(square)).alias("norm"))
    dots = (
        counted.filter("idf is not null")
        .join(F.broadcast(weights), "term")
        .groupBy(*keys, "notice", "licence")
        .agg(F.sum(F.col("tf") * F.col("idf") * F.col("w")).alias("dot"))
    )
    cosine = F.round(F.col("dot") / F.col("norm"), 9)
    both = dots.join(
        norms, [dots[k].eqNullSafe(norms[k]) for k in keys]
    ).select(*[dots[k] for k in keys], "licence", cosine.alias("cosine"))
    return both.filter(F.col("cosine") >= least)


def _best(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    general = F.col("licence").isin(GENERAL).alias("general")
    first = F.min(F.struct(general, (-F.col("cosine")).alias("c"), "licence", *order)).alias("b")
    return rows.groupBy(*keys).agg(first)


def blocks_of_lines(lines: Column, most: int = BLOCK_LINES) -> Column:
    """Of an array of ``t, rare`` all blocks of up to ``most`` adjacent lines, one of which is rare, that begin and end
    with a line that has words: ``line`` (the first), ``many`` and the text ``t``."""

    def blocks(many: int) -> Column:
        def worded(i: Column) -> Column:
            return F.get(lines, i)["t"].rlike(r"[\p{L}\p{N}]")

        def taken(i: Column) -> Column:
            near = F.exists(F.slice(lines, i + 1, many), lambda x: x["rare"])
            return (i + many <= F.size(lines)) & near & worded(i) & worded(i + many - 1)

        starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), taken)
        text = lambda i: F.array_join(F.transform(F.slice(lines, i + 1, many), lambda x: x["t"]), "\n")
        return F.transform(starts, lambda i: F.struct(i.alias("line"), F.lit(many).alias("many"), text(i).alias("t")))

    return F.flatten(F.array(*[blocks(m) for m in range(1, most + 1)]))


def ancestors(directory: Column) -> Column:
    """The directory and all above it, with their depths; the topmost is the empty path."""
    parts = F.split(directory, "/")
    return F.transform(
        F.sequence(F.lit(0), F.when(directory == "", 0).otherwise(F.size(parts))),
        lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("above")),
    )


def license_scan(
    files: DataFrame,
    path_col: str = "path",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
    notices: list[tuple[str, str]] = NOTICES,
    least: float = LEAST_COSINE,
) -> DataFrame:
    """A row per file: ``path``, the columns of ``keep``, ``license``, ``cosine`` and ``line`` of its own notice, the
    first of several (line -1: the file as a whole), ``inherited_from`` (a directory) where the licence is inherited."""
    notices = [n for n in notices if notice_terms(n[1])]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = files.select(
        *[F.col(c).alias(f"k_{c}") for c in keep], F.col(path_col).alias("path"),
        text.alias("text"), F.xxhash64(text).alias("h"),
    )
    idf, other = _weights(rows, notices)
    rare = _lit_array(rare_terms(notices, idf, least))
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("t"), F.arrays_overlap(terms(x), rare).alias("rare")))
    whole = F.struct(F.lit(-1).alias("line"), F.lit(0).alias("many"), F.col("text").alias("t"))
    # A file has a rare term if one of its lines has.
    found = rows.select("path", "h", "text", lines.alias("lines")).filter(F.exists("lines", lambda x: x["rare"]))
    parts = found.select("path", "h", F.explode(F.concat(F.array(whole), blocks_of_lines(F.col("lines")))).alias("x"))
    parts = parts.groupBy("path", "h", "x.line", "x.many").agg(F.first("x.t").alias("t"))
    matched = written(
        _cosines(parts.select("path", "h", "line", "many", terms(F.col("t")).alias("words")), notices, idf, other, least),
        "matches",
    )
    own = _best(matched, ["path", "h"], F.col("line")).select(
        "path", "h", F.col("b.licence").alias("own"), (-F.col("b.c")).alias("cosine"), F.col("b.line").alias("line")
    )
    directory = F.regexp_replace("path", "/?[^/]*$", "")
    named = F.regexp_extract("path", "[^/]*$", 0).rlike(NAMES)
    speaking = _best(
        matched.filter(F.col("path").isNotNull() & ((F.col("line") == -1) | named)).withColumn("directory", directory),
        ["directory"], F.col("path"),
    ).select(F.col("directory").alias("above"), F.col("b.licence").alias("given"))
    # Directories are resolved once each, however many files they hold.
    directories = rows.filter("path is not null").select(directory.alias("directory")).distinct()
    steps = directories.select("directory", F.explode(ancestors(F.col("directory"))).alias("a"))
    nearest = (
        steps.select("directory", "a.depth", "a.above")
        .join(speaking, "above")
        .groupBy("directory")
        .agg(F.max(F.struct("depth", "above", "given")).alias("n"))
        .select("directory", F.col("n.above").alias("above"), F.col("n.given").alias("given"))
    )
    listed = rows.select(*[f"k_{c}" for c in keep], "path", "h").withColumn("directory", directory)
    joined = (
        listed.join(
            own.select(F.col("path").alias("p"), F.col("h").alias("q"), "own", "cosine", "line"),
            F.col("path").eqNullSafe(F.col("p")) & (F.col("h") == F.col("q")), "left",
        )
        .join(nearest, "directory", "left")
    )
    return joined.select(
        *[F.col(f"k_{c}").alias(c) for c in keep], "path",
        F.coalesce("own", "given").alias("license"), "cosine", "line",
        F.when(F.col("own").isNull(), F.col("above")).alias("inherited_from"),
    )
