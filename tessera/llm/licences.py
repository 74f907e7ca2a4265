"""Licence scan: a trained paragraph classifier, in DataFrame and SQL functions only.

A paragraph is what stands between blank lines, its wrapped lines joined; where it has several sentences, each is judged
by itself, as a notice may name several licences. Sparse word n-grams (one and two words) of a multinomial logistic
regression give scores for the licence families and for *unknown*; the temperature that turns scores into
probabilities is fitted on examples that the weights haven't seen, and a family needs a probability of
``LEAST_PROBABILITY``. A predicted family is confirmed by one of its templates, if ``LEAST_SHARE`` of the template's words are
there and ``LEAST_OWN`` of those that only this family's templates have (so words that any licence line has confirm nothing).

Training (numpy on the driver, some seconds, fixed seed) uses variations of the templates below and invented
text. *Unknown* is learned from prose with cue words and from the templates with invented names in the place of the
family's own words, other names for the weights than for the temperature: so it covers licences that no family has.
Every n-gram with a weight has a cue word, so a sentence without one has the score of *unknown*
alone, and only others are taken apart. Weights are whole millionths, so sums are exact in any order.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of, written

#: How licences are stated.
TEMPLATES = {
    "agpl": ["Licensed under the GNU Affero General Public License, version 3.", "You should have received a copy of the GNU Affero General Public License along with this program", "SPDX-License-Identifier: AGPL-3.0-or-later", "Released under the AGPL"],
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "Distributed under the Apache Software License"],
    "bsd": ["Released under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause", "Licensed under the 3-clause BSD license"],
    "boost": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC-SA 4.0."],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0", "Licensed under the Eclipse Public License"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: GPL-3.0-or-later", "Released under the GPL"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only", "Released under the LGPL"],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT", "Licensed under the MIT license"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "Licensed under the MPL"],
    "public-domain": ["This work is dedicated to the public domain.", "This is free and unencumbered software released into the public domain.", "Released under CC0 1.0 Universal"],
    "reserved": ["All rights reserved.", "Copyright 2020 Example. All rights reserved.", "Unauthorized copying of this file is strictly prohibited"],
}
#: Words too common to be cues.
COMMON = frozenset("the of a an and or in to is are be this that you your may not use with without for as by it its can any at on into if all file following one program person provided version work free".split())
UNKNOWN = len(TEMPLATES)
FAMILIES = sorted(TEMPLATES)
WORD = r"[a-z0-9]+(?:\.[0-9]+)?"
LEAST_PROBABILITY, LEAST_SHARE, LEAST_OWN = 0.5, 0.6, 0.5
EXAMPLES, STEPS, SEED = 140, 250, 11
#: Between two sentences: a blank line, or an end of a sentence and white space. Other line ends are within one.
BETWEEN = r"\n[ \t\r]*\n|[.!?][ \t\r\n]+"


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def grams_of(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}


@lru_cache(maxsize=1)
def templates() -> list[tuple[int, list[str], list[str]]]:
    """(family, its words, those of them that no other family's templates have), of each template."""
    words = [(k, sorted(set(words_of(t)))) for k, name in enumerate(FAMILIES) for t in TEMPLATES[name]]
    by = {k: {w for n, ws in words if n != k for w in ws} for k in range(UNKNOWN)}
    return [(k, ws, [w for w in ws if w not in by[k]]) for k, ws in words]


@lru_cache(maxsize=1)
def model() -> tuple[dict[str, list[int]], list[int], float, list[str]]:
    """(weights by n-gram, biases, temperature, cue words); weights and biases in millionths, unknown last."""
    rng = np.random.default_rng(SEED)
    texts = [(k, words_of(t)) for k, name in enumerate(FAMILIES) for t in TEMPLATES[name]]
    cues = sorted({w for _, t in texts for w in t if w not in COMMON and not w[0].isdigit()})
    vocabulary = sorted({g for _, t in texts for g in grams_of(t) if g.split()[0] in cues or " " in g and g.split()[1] in cues} - COMMON)
    number = {g: i for i, g in enumerate(vocabulary)}
    common, syllables = sorted(COMMON), ["an", "the", "ver", "eau", "ing", "st", "lo", "ca", "ri", "de", "ung", "ou", "nt", "er"]

    def filler(n: int) -> list[str]:
        return [str(rng.choice(common)) if rng.random() < 0.4 else "".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(n)]

    own = {k: {w for n, _, mine in templates() if n == k for w in mine} for k in range(UNKNOWN)}

    def example() -> tuple[list[str], int]:
        if rng.random() < 0.2:  # a licence that no family has: another name in the place of a family's own words
            k, template = texts[rng.integers(0, len(texts))]
            words = [w if w not in own[k] else filler(1)[0] for w in template]
            if not own[k].isdisjoint(template):
                return filler(int(rng.integers(0, 8))) + words + filler(int(rng.integers(0, 8))), UNKNOWN
        if rng.random() < 0.3:
            words = filler(int(rng.integers(2, 40)))
            for _ in range(rng.integers(0, 4)):  # cue words in ordinary text
                words.insert(int(rng.integers(0, len(words) + 1)), str(rng.choice(cues)))
            return words, UNKNOWN
        k, template = texts[rng.integers(0, len(texts))]
        words = [w for w in template if rng.random() > 0.04] or list(template)
        return filler(int(rng.integers(0, 8))) + words + filler(int(rng.integers(0, 8))), k

    n = EXAMPLES * (len(FAMILIES) + 1)
    sets = []
    for _ in range(2):
        x, y = np.zeros((n, len(vocabulary) + 1), np.float32), np.zeros(n, int)
        for i in range(n):
            words, y[i] = example()
            x[i, [number[g] for g in grams_of(words) if g in number]] = 1
        x[:, -1] = 1
        sets.append((x, y))
    (x, y), (held, truth) = sets
    w, speed = np.zeros((x.shape[1], UNKNOWN + 1), np.float32), np.zeros((x.shape[1], UNKNOWN + 1), np.float32)
    target = np.eye(UNKNOWN + 1, dtype=np.float32)[y]
    for _ in range(STEPS):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        gradient = x.T @ (p - target) / n + 2e-4 * w
        speed = 0.9 * speed + gradient
        w -= 1.5 * speed
    z = held @ w

    def loss(t: float) -> float:
        s = z / t
        return float(-(s[np.arange(n), truth] - s.max(axis=1) - np.log(np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1))).mean())

    temperature = min((0.25 * 1.1**k for k in range(30)), key=loss)
    whole = np.rint(w.astype(np.float64) * 1e6).astype(np.int64)
    if whole[-1].argmax() != UNKNOWN:
        raise ValueError("text without cues must be unknown")
    return {g: whole[i].tolist() for g, i in number.items()}, whole[-1].tolist(), round(temperature, 6), cues


def gate() -> str:
    """Pattern that a paragraph with a cue word, in lower case, matches."""
    return r"(?<![a-z0-9])(?:" + "|".join(model()[3]) + ")(?![a-z0-9])"


def weights_rows() -> list[str]:
    return [f"('{g}', {', '.join(map(str, w))})" for g, w in sorted(model()[0].items())]


def template_rows() -> list[str]:
    listed = lambda words: "array(" + ", ".join(f"'{w}'" for w in words) + ")"
    return [f"({k}, {listed(words)}, {listed(own)})" for k, words, own in templates() if own]


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    names = ", ".join(f"c{k}" for k in range(UNKNOWN + 1))
    return spark.sql(f"SELECT * FROM VALUES {', '.join(weights_rows())} AS t(gram, {names})"), spark.sql(f"SELECT * FROM VALUES {', '.join(template_rows())} AS t(family, template, own)")


def paragraphs(docs: DataFrame) -> DataFrame:
    """row, doc_id, lines (array of place and words: sentences with a cue word), written to the shared folder."""
    cues = F.array(*(F.lit(c) for c in model()[3]))
    lines = F.transform(F.split(F.col("text"), BETWEEN, -1), lambda x, i: F.struct(i.alias("place"), F.lower(x).alias("line")))
    lines = F.filter(lines, lambda x: x["line"].rlike(gate()))
    lines = F.transform(lines, lambda x: F.struct(x["place"].alias("place"), F.regexp_extract_all(x["line"], F.lit(WORD), F.lit(0)).alias("words")))
    found = F.filter(lines, lambda x: F.arrays_overlap(x["words"], cues))
    none = F.array().cast("array<struct<place:int,words:array<string>>>")
    named = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_of().alias("text"))
    return written(named.select("row", "doc_id", F.when(F.lower("text").rlike(gate()), found).otherwise(none).alias("lines")), "paragraphs")


def classified(found: DataFrame) -> DataFrame:
    """row, place, family (number; UNKNOWN among them), probability, near (whether a template confirms it): a row for each sentence with a cue word."""
    weights, known = _tables(found.sparkSession)
    _, bias, temperature, _ = model()
    lines = found.select("row", F.explode("lines").alias("l")).select("row", F.col("l.place").alias("place"), F.col("l.words").alias("all"))
    pairs = F.zip_with(F.slice("all", 1, F.size("all") - 1), F.slice("all", 2, F.size("all") - 1), lambda x, y: F.concat_ws(" ", x, y))
    grams = lines.select("row", "place", F.array_distinct("all").alias("words"), F.array_distinct(F.concat("all", pairs)).alias("grams"))
    # the fixed tables are small: a few hundred rows
    sums = grams.select("row", "place", F.explode("grams").alias("gram")).join(F.broadcast(weights), "gram").groupBy("row", "place").agg(*(F.sum(f"c{k}").alias(f"s{k}") for k in range(UNKNOWN + 1)))
    score = lambda k: (F.coalesce(f"s{k}", F.lit(0)) + F.lit(bias[k])) / F.lit(1e6 * temperature)
    scored = grams.join(sums, ["row", "place"], "left").select("row", "place", "words", F.array(*(score(k) for k in range(UNKNOWN + 1))).alias("z"))
    top = F.array_max("z")
    total: Column = F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    best = scored.select("row", "place", "words", (F.array_position("z", top) - 1).cast("int").alias("family"), (1 / total).alias("probability"))
    held = lambda words, least: F.size(F.array_intersect("words", words)) >= least * F.size(words)
    near = best.join(F.broadcast(known), "family").select("row", "place", (held("template", LEAST_SHARE) & held("own", LEAST_OWN)).alias("near"))
    near = near.groupBy("row", "place").agg(F.max("near").alias("near"))
    return best.drop("words").join(near, ["row", "place"], "left").withColumn("near", F.coalesce("near", F.lit(False)))


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, licences (confirmed families, sorted, comma-joined), n_confirmed and n_unconfirmed
    (sentences with a predicted family that a template does or doesn't confirm) and n_unknown (other sentences with a cue word).

    Null text is empty; repeated rows are each reported; an empty table gives no rows; other columns are ignored; a text of any
    length is scanned whole (sentences without a cue word are left at once).
    """
    found = paragraphs(docs)
    some = found.filter(F.size("lines") > 0).select("row", "doc_id", "lines")
    predicted = (F.col("family") != UNKNOWN) & (F.col("probability") >= LEAST_PROBABILITY)
    confirmed = predicted & F.col("near")
    names = F.array(*(F.lit(x) for x in [*FAMILIES, "unknown"]))
    by_row = classified(some).groupBy("row").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(confirmed, F.element_at(names, F.col("family") + 1)))), ",").alias("licences"),
        F.count(F.when(confirmed, 1)).alias("n_confirmed"), F.count(F.when(predicted & ~confirmed, 1)).alias("n_unconfirmed"), F.count(F.when(~predicted, 1)).alias("n_unknown"),
    )
    full = some.select("row", "doc_id").join(by_row, "row").drop("row")
    zero = F.lit(0).cast("long")
    rest = found.filter(F.size("lines") == 0).select("doc_id", F.lit("").alias("licences"), zero.alias("n_confirmed"), zero.alias("n_unconfirmed"), zero.alias("n_unknown"))
    return full.unionByName(rest)


def oracle_sql() -> str:
    """The scan in DuckDB SQL, with the trained weights as a table."""
    _, bias, temperature, cues = model()
    cues = ", ".join(f"'{c}'" for c in cues)
    names = ", ".join(f"c{k}" for k in range(UNKNOWN + 1))
    sums = ", ".join(f"sum(c{k}) AS s{k}" for k in range(UNKNOWN + 1))
    scores = ", ".join(f"(coalesce(s{k}, 0) + {bias[k]}) / {1e6 * temperature!r}" for k in range(UNKNOWN + 1))
    families = ", ".join(f"'{x}'" for x in [*FAMILIES, "unknown"])
    known = ", ".join(template_rows()).replace("array(", "list_value(")
    return f"""
WITH weights(gram, {names}) AS (VALUES {", ".join(weights_rows())}),
templates(family, template, own) AS (VALUES {known}),
lines AS (SELECT doc_id, i AS place, regexp_extract_all(lower(l[i]), '{WORD}') AS w
          FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '{BETWEEN}') AS l FROM documents))
          WHERE len(list_intersect(regexp_extract_all(lower(l[i]), '{WORD}'), [{cues}])) > 0),
grams AS (SELECT DISTINCT doc_id, place, gram FROM (
    SELECT doc_id, place, unnest(w) AS gram FROM lines UNION ALL
    SELECT doc_id, place, w[i] || ' ' || w[i + 1] FROM (SELECT doc_id, place, w, unnest(range(1, len(w))) AS i FROM lines))),
sums AS (SELECT doc_id, place, {sums} FROM grams JOIN weights USING (gram) GROUP BY doc_id, place),
scored AS (SELECT doc_id, place, list_distinct(w) AS w, [{scores}] AS z FROM lines LEFT JOIN sums USING (doc_id, place)),
best AS (SELECT doc_id, place, w, list_position(z, list_max(z)) - 1 AS family, 1 / list_sum([exp(x - list_max(z)) FOR x IN z]) AS p FROM scored),
shares AS (SELECT doc_id, place, bool_or(len(list_intersect(w, template)) >= {LEAST_SHARE} * len(template) AND len(list_intersect(w, own)) >= {LEAST_OWN} * len(own)) AS near FROM best JOIN templates USING (family) GROUP BY doc_id, place),
judged AS (SELECT doc_id, list_value({families})[family + 1] AS name, family <> {UNKNOWN} AND p >= {LEAST_PROBABILITY} AS predicted, coalesce(near, false) AS near
           FROM best LEFT JOIN shares USING (doc_id, place)),
agg AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) FILTER (predicted AND near) AS licences, count(*) FILTER (predicted AND near) AS a,
               count(*) FILTER (predicted AND NOT near) AS b, count(*) FILTER (NOT predicted) AS c FROM judged GROUP BY doc_id)
SELECT doc_id, coalesce(licences, '') AS licences, coalesce(a, 0) AS n_confirmed, coalesce(b, 0) AS n_unconfirmed, coalesce(c, 0) AS n_unknown
FROM documents LEFT JOIN agg USING (doc_id)
"""
