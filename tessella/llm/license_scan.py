"""License scanning, in DataFrame functions only: sparse TF-IDF cosine of headers and
licence files to templates, then inheritance from the nearest ancestor directory.

Templates are customary header sentences, opening sentences, SPDX lines and the whole texts of the
licences (`licenses/`); headers and whole files are compared to all of them.

Every whole file is scanned. Its units are its lines, its sentences (cut at blank lines and at
a full stop, exclamation or question mark before white space, comment marks at line beginnings
left out and wrapped lines joined) and the whole file. A unit is a vector of words (runs of a-z,
0-9 and dots inside numbers) weighted by term frequency times ln((1 + files) / (1 + files with
the word)) + 1. The document frequencies of the templates' words are counted over all files; a
word outside the templates weighs as one that no file holds. A line or sentence with a cosine
of at least `header` to a template is a header; a file whose whole text has at least `whole` to
one is a licence file, and stands for its directory. Files without a header get the licence of
the nearest ancestor directory that has a licence file, by joins of directory paths.

Vectors are made only for files that can matter. The squared weights, in a normed template, of
the words that a unit shares with it sum to the square of the cosine at least (Cauchy-Schwarz),
and a file holds all words of its units. So a file whose words hold less than `whole` squared
(`header` squared if that is less) of every template is left out, and so is a unit of the files
that remain; no match is lost. Cheaper forms of it go first: of each template the words in most
files are set aside while they hold less than that, so a match has one of the others (an anchor),
and it has as many words as the template's heaviest words needed to hold that. A unit meets only the
templates that pass for it. Units are counted inside their rows.

Among equal cosines the licence that sorts first is taken, among a directory's licence files
the one with the greatest cosine.

Defined cases: null and empty texts hold no licence but inherit one; null paths are the
root's; each row is judged by its own path and text, repeated rows each; other columns are
ignored; an empty table gives an empty result. Scale: two scans of the texts, the second only to
fetch the texts that can matter; templates are fixed and small, and the joins by path are on
distinct directories. Templates are a parameter, so whole licence texts can be added.
"""

from __future__ import annotations

import itertools
import math
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, maybe_broadcast

# Customary header sentences and opening sentences of public licences; their whole texts are added below.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the Apache License, Version 2.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version."],
    "GPL-1.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1, or any later version."],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."],
    "LGPL-2.1": ["Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version."],
    "LGPL-2.0": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version."],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."],
    "MPL-1.1": ["The contents of this file are subject to the Mozilla Public License Version 1.1."],
    "GFDL-1.2": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.2 or any later version published by the Free Software Foundation."],
    "GFDL-1.3": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation."],
    "Artistic-1.0-Perl": ["Licensed under the Artistic License."],
    "ISC": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Licensed under CC0 1.0."],
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
for _name, _said in TEMPLATES.items():
    _said.append(f"SPDX-License-Identifier: {_name}")
    _said.append((resources.files(__package__) / "licenses" / f"{_name}.txt").read_text(encoding="utf-8"))
_WORD = r"[a-z0-9]+(?:\.[0-9]+)*"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def _templates(spark, templates: dict[str, list[str]]) -> DataFrame:
    rows = [(k, i, s) for k, v in templates.items() for i, s in enumerate(v)]
    return spark.createDataFrame(rows, "license string, part int, said string")


def _among(words) -> str:
    """Words of a-z, 0-9 and dots as a list of SQL, looked up as a set; the empty word is none."""
    return "(" + ", ".join(f"'{w}'" for w in ["", *sorted(words)]) + ")"


def units_of(text: Column) -> Column:
    """Lines and sentences of a text, each once."""
    lines = F.split(text, r"\n")
    joined = F.regexp_replace(F.regexp_replace(text, r"(?m)^[ \t]*(?:/\*+|\*+/|\*+|//+|#+|--+|;+|%+)[ \t]?", ""), r"(?<!\n)\r?\n(?!\r?\n)", " ")
    sentences = F.split(joined, r"\n|(?<=[.!?])\s+")
    return F.filter(F.array_distinct(F.concat(lines, sentences)), lambda s: F.length(s) > 0)


def scan(files: DataFrame, id_column: str = "doc_id", path_column: str = "path", text_column: str = "text", header: float = 0.8, whole: float = 0.5, templates: dict[str, list[str]] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Rows (id, path, license, found, score), one per row of files. found: header, file,
    inherited or none; score: the cosine (of the directory's licence file where inherited)."""
    spark = files.sparkSession
    scratch = scratch or Scratch(spark, "licenses")
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    base = files.select(F.col(id_column).alias("id"), F.coalesce(F.col(path_column).cast("string"), F.lit("")).alias("path"), text.alias("text"))
    # Rows of one path and one text have one result; the text stands in by 128 bits.
    same = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), F.col("text")).alias("h2")]

    words = _templates(spark, templates or TEMPLATES).select("license", "part", F.explode(words_of(F.col("said"))).alias("word"))
    counted = words.groupBy("license", "part", "word").agg(F.count("*").alias("tf")).collect()  # fixed size
    vocabulary = sorted({r["word"] for r in counted})
    known = F.expr(f"filter(array_distinct(words), w -> w in {_among(vocabulary)})").alias("has")
    rows = scratch.put(base.select("id", "path", *same, words_of(F.col("text")).alias("words")).select("id", "path", "h1", "h2", known), "rows")
    df = {r["word"]: r["df"] for r in rows.select(F.explode("has").alias("word")).groupBy("word").agg(F.count("*").alias("df")).collect()}
    n = rows.count()

    def idf(k: int) -> float:
        return math.log((1 + n) / (1 + k)) + 1

    squares: dict[tuple, dict[str, float]] = {}
    for r in counted:
        squares.setdefault((r["license"], r["part"]), {})[r["word"]] = (r["tf"] * idf(df.get(r["word"], 0))) ** 2

    def anchors(each: dict[str, float], least: float) -> set[str]:
        """Of these squared weights words that are enough: the others hold less than least squared."""
        out, left = set(), (least**2 - 1e-9) * sum(each.values())
        for w in sorted(each, key=lambda w: (-df.get(w, 0), w)):
            if each[w] < left:
                left -= each[w]
            else:
                out.add(w)
        return out

    def fewest(each: dict[str, float], least: float) -> int:
        """So many different words of a template hold least squared of it at least."""
        held = itertools.accumulate(sorted(each.values(), reverse=True))
        return next((i for i, x in enumerate(held, 1) if x >= (least**2 - 1e-9) * sum(each.values())), len(each))

    row = F.monotonically_increasing_id().alias("row")  # keeps what follows from being worked out again for each use
    names = F.array(*[F.lit(k) for k, _ in squares])
    flat = [(i, w, math.sqrt(x / sum(each.values()))) for i, each in enumerate(squares.values()) for w, x in each.items()]
    template = F.broadcast(spark.createDataFrame(flat, "key int, word string, t double"))
    pairs = [(w, i, fewest(each, header)) for i, each in enumerate(squares.values()) for w in anchors(each, header)]
    least = min(header, whole)
    some = _among({w for each in squares.values() for w in anchors(each, least)})

    marked = rows.where(F.expr(f"exists(has, w -> w in {some})")).select(row, "h1", "h2", "has").select("row", "h1", "h2", F.explode("has").alias("word"))
    marked = marked.join(template, "word").groupBy("row", "h1", "h2", "key").agg(F.sum(F.col("t") ** 2).alias("held")).where(F.col("held") >= least**2 - 1e-9)
    # The templates of which a file holds enough as a whole; lines and sentences have theirs below.
    suspects = scratch.put(marked.groupBy("h1", "h2").agg(F.collect_set(F.when(F.col("held") >= whole**2 - 1e-9, F.col("key"))).alias("files")), "suspects")
    texts = base.select(*same, "text").join(maybe_broadcast(suspects.select("h1", "h2")), ["h1", "h2"], "left_semi")
    texts = scratch.put(texts.groupBy("h1", "h2").agg(F.any_value("text").alias("text")).join(maybe_broadcast(suspects), ["h1", "h2"]), "texts")
    units = texts.select("h1", "h2", "files", F.posexplode(F.concat(F.array("text"), units_of(F.col("text")))).alias("unit", "said"))
    units = units.select(row, "h1", "h2", "unit", F.when(F.col("unit") == 0, F.col("files")).alias("files"), words_of(F.col("said")).alias("words"))
    units = units.where(F.when(F.col("unit") == 0, F.size("files") > 0).otherwise(F.expr(f"exists(words, w -> w in {_among({w for w, *_ in pairs})})")))
    # Term frequencies and the length of the vector, inside the row, by the runs of the sorted words.
    # Of words outside the templates only the squares of the frequencies are added up.
    counted_in = F.expr(f"""transform(array(sort_array(filter(words, w -> w in {_among(vocabulary)}))), s ->
        transform(array(filter(sequence(0, size(s) - 1), i -> i = 0 or get(s, i) != get(s, i - 1))), starts ->
            transform(starts, (i, k) -> struct(get(s, i) as word, cast(coalesce(get(starts, k + 1), size(s)) - i as double) as tf)))[0])[0]""").alias("tfs")
    runs = F.expr(f"""aggregate(sort_array(filter(words, x -> x not in {_among(vocabulary)})), named_struct('last', '', 'run', 0L, 'sum', 0D),
        (a, x) -> if(x = a.last, named_struct('last', x, 'run', a.run + 1L, 'sum', a.sum + 2 * a.run + 1D), named_struct('last', x, 'run', 1L, 'sum', a.sum + 1D)), a -> a.sum)""")
    units = scratch.put(units.select("row", "h1", "h2", "unit", "files", counted_in, runs.alias("others")), "units")
    # A line or sentence is compared to the templates of which it has an anchor and words enough.
    held = units.where("unit > 0").select("row", F.size("tfs").alias("n"), F.explode("tfs.word").alias("word"))
    held = held.join(F.broadcast(spark.createDataFrame(pairs, "word string, key int, fewest int")), "word").where("n >= fewest")
    keys = F.when(F.col("unit") == 0, F.col("files")).otherwise(F.col("keys"))
    units = units.join(held.groupBy("row").agg(F.collect_set("key").alias("keys")), "row", "left").withColumn("keys", keys).where(F.size("keys") > 0)
    tokens = units.select("row", "h1", "h2", "unit", "others", "keys", F.explode("tfs").alias("x")).select("row", "h1", "h2", "unit", "others", F.explode("keys").alias("key"), "x.word", "x.tf")
    weights = F.broadcast(spark.createDataFrame([(w, idf(df.get(w, 0))) for w in vocabulary], "word string, idf double"))
    weight = F.col("tf") * F.col("idf")
    sums = [F.sum(weight * F.col("t")).alias("dot"), F.sum(F.col("t") ** 2).alias("held"), F.sqrt(F.sum(weight**2) + F.first("others") * idf(0) ** 2).alias("norm")]
    dots = tokens.join(weights, "word").join(template, ["key", "word"], "left").groupBy("row", "h1", "h2", "unit", "key").agg(*sums)
    dots = dots.where(F.col("held") >= F.when(F.col("unit") == 0, whole**2).otherwise(header**2) - 1e-9)
    cosines = dots.select("h1", "h2", "unit", F.element_at(names, F.col("key") + 1).alias("license"), (F.col("dot") / F.col("norm")).alias("score"))
    good = cosines.where(F.when(F.col("unit") == 0, F.col("score") >= whole).otherwise(F.col("score") >= header))

    def top(where: Column) -> Column:
        return F.min(F.when(where, F.struct((-F.round("score", 9)).alias("s"), "license")))

    told = good.groupBy("h1", "h2").agg(top(F.col("unit") > 0).alias("header"), top(F.col("unit") == 0).alias("file"))
    told = scratch.put(told.select("h1", "h2", *[F.col(f"{x}.license").alias(f"{x}_license") for x in ("header", "file")], *[(-F.col(f"{x}.s")).alias(f"{x}_score") for x in ("header", "file")]), "told")

    parent = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", r"/[^/]*$", "")).otherwise(F.lit(""))
    rows = rows.select("id", "path", "h1", "h2", parent.alias("dir")).join(maybe_broadcast(told), ["h1", "h2"], "left")
    rows = scratch.put(rows.drop("h1", "h2"), "judged")
    licensed = rows.where("file_license is not null").groupBy("dir").agg(F.min(F.struct((-F.col("file_score")).alias("s"), F.col("file_license").alias("license"))).alias("b"))
    licensed = scratch.put(licensed.select(F.col("dir").alias("up"), F.col("b.license").alias("dir_license"), (-F.col("b.s")).alias("dir_score")), "licensed")
    dirs = rows.select("dir").distinct()
    parts = F.split("dir", "/")
    ups = dirs.select("dir", F.posexplode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))).alias("depth", "up"))
    inherited = ups.join(maybe_broadcast(licensed), "up").groupBy("dir").agg(F.max_by(F.struct("dir_license", "dir_score"), "depth").alias("i"))
    inherited = scratch.put(inherited.select("dir", "i.dir_license", "i.dir_score"), "inherited")

    rows = rows.join(maybe_broadcast(inherited), "dir", "left")
    found = F.when(F.col("header_license").isNotNull(), "header").when(F.col("file_license").isNotNull(), "file").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none")
    return rows.select("id", "path", F.coalesce("header_license", "file_license", "dir_license").alias("license"), found.alias("found"), F.coalesce("header_score", "file_score", "dir_score").alias("score"))
