"""License scans: text units against license templates by Dice coefficient over word bigrams.

Units are the lines, the blocks between blank lines and the whole of a text; each is normalised to
lower-cased runs of letters and digits. With a bigrams of a unit, b of a template and s shared ones (sets),
Dice is 2s / (a + b). Because s is at most the smaller of a and b, a template can reach `LEAST` only with
units of b * LEAST / (2 - LEAST) to b * (2 - LEAST) / LEAST bigrams; other pairs of unit and template are
never compared. Units that fit no template, or that lack every bigram of one, go before anything is joined.
A unit counts for its best template only: highest coefficient, then more bigrams, then the later name.

A notice inside a longer line, or wrapped within a block, is found by windows: every stretch of the text's
words that is as long as a template and starts with one of its bigrams. Here bigrams count as often as they
occur, in the window and in the template. The same bound says how many shared bigrams a window needs, so
starts without that many of them close enough ahead go before a window is looked at. Of windows that overlap,
those beaten by another one (coefficient, length, place, name) are dropped.

Defined cases: null and empty texts, and units of fewer than two words, match nothing; equal units of a
text count once; documents are told apart by doc_id, so rows that repeat one are taken together (equal
texts of one doc_id count once); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketreach.session import stage

LEAST = 0.8

# The usual words of each notice, and of the texts of short licenses.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the Software), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation; either version 2 of the License, "
        "or (at your option) any later version.",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the "
        "License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "Lesser General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "Affero General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version.",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public "
        "License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    "Zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors "
        "be held liable for any damages arising from the use of this software.",
    ),
    "CC-BY-NC-SA-4.0": (
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International "
        "License.",
    ),
    "CC-BY-NC-ND-4.0": (
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International "
        "License.",
    ),
    "CC-BY-ND-4.0": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:",
    ),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.",),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
        "MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "CC0-1.0": ("This work is dedicated to the public domain under CC0 1.0 Universal.",),
}


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none gives one empty word."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def pairs_of(found: str) -> Column:
    """Pairs of neighbours of an array column of words, in order."""
    last = F.greatest(F.size(found) - 1, F.lit(1))
    pairs = F.transform(
        F.slice(found, 1, last), lambda w, i: F.concat_ws(" ", w, F.get(F.col(found), i + 1))
    )
    return F.when(F.size(found) > 1, pairs).otherwise(F.array().cast("array<string>"))


def bigrams(found: str) -> Column:
    """Distinct pairs of neighbours of an array column of words."""
    return F.array_distinct(pairs_of(found))


def _once(value: Column) -> Column:
    """A value that is made once a row: it passes a generator, behind which nothing is moved."""
    return F.explode(F.array(value))


def templates(spark) -> DataFrame:
    """(license, template, pairs, bigrams, b, low, high), from the fixed values."""
    rows = [(name, i, text) for name, texts in TEMPLATES.items() for i, text in enumerate(texts)]
    made = spark.createDataFrame(rows, "license string, template int, text string")
    made = made.select("license", "template", words(F.col("text")).alias("w"))
    made = made.select("license", "template", pairs_of("w").alias("pairs"), bigrams("w").alias("bigrams"))
    b = F.size("bigrams")
    return made.select(
        "license", "template", "pairs", "bigrams", b.alias("b"),
        F.ceil(F.round(b * LEAST / (2 - LEAST), 6)).alias("low"), F.floor(F.round(b * (2 - LEAST) / LEAST, 6)).alias("high"),
    )


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, unit, w): distinct units of each row and their words."""
    text = F.col("text")
    parts = F.concat(F.split(text, "\n"), F.split(text, r"\n[ \t\r]*\n"), F.array(text))
    rows = docs.filter(text.isNotNull()).select("doc_id", F.explode(F.array_distinct(parts)).alias("unit"))
    return rows.select("doc_id", "unit", _once(words(F.col("unit"))).alias("w"))


def matches(docs: DataFrame) -> DataFrame:
    """(doc_id, license, template, unit, b, dice) of every unit that reaches a template."""
    spark = docs.sparkSession
    held = templates(spark).collect()  # fixed values only
    # repeated words make a unit's distinct bigrams fewer than its words, so only the lower bound is
    # taken from the words; both are taken from the distinct bigrams below
    lowest, highest = min(t.low for t in held), max(t.high for t in held)
    known = sorted({g for t in held for g in t.bigrams})
    rows = units(docs).filter(F.size("w") > lowest)
    rows = rows.select("doc_id", "unit", _once(bigrams("w")).alias("g")).filter(
        F.size("g").between(lowest, highest) & F.arrays_overlap("g", F.array(*map(F.lit, known)))
    )
    rows = rows.select("doc_id", F.xxhash64("unit").alias("unit"), F.size("g").alias("a"), F.explode("g").alias("bigram"))
    each = templates(spark).select("license", "template", "b", "low", "high", F.explode("bigrams").alias("bigram"))
    met = rows.join(F.broadcast(each), "bigram").filter("a between low and high")  # fixed values: some hundred rows
    shared = met.groupBy("doc_id", "unit", "license", "template", "a", "b").agg(F.count_distinct("bigram").alias("s"))
    dice = F.round(2 * F.col("s") / (F.col("a") + F.col("b")), 6)
    return shared.select("doc_id", "license", "template", "unit", "b", dice.alias("dice")).filter(F.col("dice") >= LEAST)


def windows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_id, license, template, n, start, stop, dice) of every window that reaches its template.

    Places count words; stops are exclusive. n is the number of bigrams of the template, repeats included.
    """
    made = templates(docs.sparkSession)
    n = F.size("pairs")
    least = F.ceil(F.round(n * LEAST / (2 - LEAST), 6)).cast("int")
    times = F.size(F.filter("pairs", lambda p: p == F.col("bigram")))
    each = made.select("*", n.alias("n"), least.alias("least"), F.posexplode("bigrams").alias("k", "bigram"))
    each = each.select("license", "template", "n", "least", "k", "bigram", times.alias("c"))
    held = each.collect()  # fixed values only
    known = F.array(*[F.lit(g) for g in sorted({t.bigram for t in held})])
    # a window needs `least` bigrams of its template, repeats included; as many distinct ones less its repeats
    repeats = {(t.license, t.template): 0 for t in held}
    for t in held:
        repeats[t.license, t.template] += t.c - 1
    fewest = max(1, min(t.least - repeats[t.license, t.template] for t in held))

    rows = docs.filter(F.col("text").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("text_id"), _once(words(F.col("text"))).alias("w")
    )
    rows = rows.filter(F.size("w") > fewest).select("doc_id", "text_id", _once(pairs_of("w")).alias("g"))
    rows = rows.filter(F.size(F.array_intersect("g", known)) >= fewest)
    rows = rows.select("doc_id", "text_id", F.size("g").alias("length"), F.posexplode("g").alias("pos", "bigram"))
    met = rows.join(F.broadcast(each), "bigram")  # fixed values: some hundred rows
    place = F.collect_set(F.struct("pos", "k", "c"))
    text = met.groupBy("doc_id", "text_id", "length", "license", "template", "n", "least").agg(place.alias("places"))
    text = text.filter(F.size("places") >= F.col("least")).withColumn("places", _once(F.array_sort("places")))
    # the bigram that would be the last one needed must lie within the window
    starts = F.filter(
        F.sequence(F.lit(0), F.size("places") - F.col("least")),
        lambda i: F.get("places", i + F.col("least") - 1)["pos"] < F.get("places", i)["pos"] + F.col("n"),
    )
    found = text.select("*", F.explode(starts).alias("i"))
    start = F.get("places", F.col("i"))["pos"]
    ahead = F.filter(F.slice("places", F.col("i") + 1, F.col("n")), lambda x: x["pos"] < start + F.col("n"))
    found = found.select("doc_id", "text_id", "license", "template", "n", "length", start.alias("start"), _once(ahead).alias("ahead"))
    kinds = F.array_distinct(F.transform("ahead", lambda x: F.struct(x["k"].alias("k"), x["c"].alias("c"))))
    shared = F.aggregate(
        kinds, F.lit(0), lambda s, x: s + F.least(x["c"], F.size(F.filter("ahead", lambda y: y["k"] == x["k"])))
    )
    a = F.least("n", F.col("length") - F.col("start"))
    found = found.select("*", a.alias("a"), _once(shared).alias("s"))
    dice = F.round(2 * F.col("s") / (F.col("a") + F.col("n")), 6)
    stop = F.col("start") + F.col("a") + 1
    found = found.select("doc_id", "text_id", "license", "template", "n", "start", stop.alias("stop"), dice.alias("dice"))
    return found.filter(F.col("dice") >= LEAST)


def unbeaten(found: DataFrame) -> DataFrame:
    """Windows that no better one overlaps.

    Windows meet in blocks as long as the longest of them, so each lies in two blocks at most and a block
    holds a bounded number of starts.
    """
    longest = max(len(text.split()) for texts in TEMPLATES.values() for text in texts) * 2
    own = ["doc_id", "text_id", "license", "template", "n", "start", "stop", "dice"]
    block = lambda at: F.floor(at / longest)
    blocks = F.explode(F.array_distinct(F.array(block(F.col("start")), block(F.col("stop") - 1))))
    each = stage(found).select(*own, blocks.alias("block"))
    x, y = each.alias("x"), each.alias("y")

    def rank(side: str) -> Column:
        return F.struct(
            *[F.col(f"{side}.{c}").alias(c) for c in ("dice", "n")], (-F.col(f"{side}.start")).alias("place"),
            *[F.col(f"{side}.{c}").alias(c) for c in ("license", "template")],
        )

    both = (
        F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.text_id") == F.col("y.text_id"))
        & (F.col("x.block") == F.col("y.block")) & (F.col("y.start") < F.col("x.stop"))
        & (F.col("x.start") < F.col("y.stop")) & (rank("y") > rank("x"))
    )
    met = x.join(y, both, "left").groupBy(*[F.col(f"x.{c}") for c in own]).agg(F.count("y.start").alias("better"))
    return met.filter("better = 0").drop("better")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, license, n_units, n_windows, dice): matching units and windows, and the best coefficient."""
    order = F.struct("dice", "b", "license")
    best = matches(docs).groupBy("doc_id", "unit").agg(F.max(order).alias("best"))
    whole = best.select("doc_id", "best.license", F.lit(1).alias("unit"), F.lit(0).alias("window"), "best.dice")
    inside = unbeaten(windows(docs)).select("doc_id", "license", F.lit(0).alias("unit"), F.lit(1).alias("window"), "dice")
    return whole.unionByName(inside).groupBy("doc_id", "license").agg(
        F.sum("unit").alias("n_units"), F.sum("window").alias("n_windows"), F.max("dice").alias("dice")
    )


def op3_licenses(spark, folder: str) -> DataFrame:
    """Licenses that every document names."""
    return scan(spark.read.parquet(f"{folder}/documents.parquet"))


_LISTED = ", ".join(
    f"('{name}', {i}, '{text.replace(chr(39), chr(39) * 2)}')"
    for name, texts in TEMPLATES.items()
    for i, text in enumerate(texts)
)
_WORDS = r"string_split(trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')"
SQL = f"""
WITH listed(license, template, text) AS (VALUES {_LISTED}),
tw AS (SELECT license, template, {_WORDS.format("text")} AS w FROM listed),
tg AS (SELECT license, template, list_distinct([w[i] || ' ' || w[i+1] for i in range(1, len(w))]) AS g FROM tw),
parts AS (SELECT DISTINCT doc_id, unnest(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\\n[ \\t\\r]*\\n'), [text])) AS unit
    FROM documents WHERE text IS NOT NULL),
uw AS (SELECT doc_id, unit, {_WORDS.format("unit")} AS w FROM parts),
ug AS (SELECT doc_id, unit, list_distinct([w[i] || ' ' || w[i+1] for i in range(1, len(w))]) AS g FROM uw),
d AS (SELECT doc_id, unit, license, len(tg.g) AS b, round(2.0::DOUBLE * len(list_intersect(ug.g, tg.g)) / (len(ug.g) + len(tg.g)), 6) AS dice
    FROM ug JOIN tg ON list_has_any(ug.g, tg.g)),
best AS (SELECT doc_id, unit, license, dice FROM d WHERE dice >= {LEAST}
    QUALIFY row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, b DESC, license DESC) = 1),
tc AS (SELECT license, template, n, bigram, count(*) AS c
    FROM (SELECT license, template, len(w) - 1 AS n, unnest([w[i] || ' ' || w[i+1] for i in range(1, len(w))]) AS bigram FROM tw) GROUP BY ALL),
texts AS (SELECT row_number() OVER () AS id, doc_id, {_WORDS.format("text")} AS w FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
places AS (SELECT id, len(w) - 1 AS length, i - 1 AS pos, w[i] || ' ' || w[i+1] AS bigram
    FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM texts)),
m AS (SELECT * FROM places JOIN tc USING (bigram)),
met AS (SELECT x.id, x.license, x.template, x.n, x.length, x.pos, y.bigram, least(count(*), any_value(y.c)) AS s
    FROM m x JOIN m y ON x.id = y.id AND x.license = y.license AND x.template = y.template AND y.pos BETWEEN x.pos AND x.pos + x.n - 1 GROUP BY ALL),
win AS (SELECT id, license, template, n, pos AS start, pos + least(n, length - pos) + 1 AS stop,
    round(2.0::DOUBLE * CAST(sum(s) AS BIGINT) / (least(n, length - pos) + n), 6) AS dice FROM met GROUP BY id, license, template, n, length, pos),
hits AS (SELECT * FROM win WHERE dice >= {LEAST}),
kept AS (SELECT * FROM hits x WHERE NOT EXISTS (SELECT 1 FROM hits y WHERE y.id = x.id AND y.start < x.stop AND x.start < y.stop
    AND row(y.dice, y.n, -y.start, y.license, y.template) > row(x.dice, x.n, -x.start, x.license, x.template))),
every AS (SELECT doc_id, license, 1 AS u, 0 AS v, dice FROM best
    UNION ALL SELECT doc_id, license, 0, 1, dice FROM kept JOIN texts USING (id))
SELECT doc_id, license, CAST(sum(u) AS BIGINT) AS n_units, CAST(sum(v) AS BIGINT) AS n_windows, max(dice) AS dice FROM every GROUP BY doc_id, license"""
