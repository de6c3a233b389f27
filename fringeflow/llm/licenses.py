"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeflow.llm.common import LOWER, UPPER, let, table, text_of
from fringeflow.llm.decontam import BREAK, word_hashes

WIDTH, LEAST = 5, 0.8
#: 64 bands of 1: a window has up to 4 times the template's shingles, so where other templates fill it and it holds 0.8 of
#: this one, their similarity is 0.8 / 4.2 = 0.19 at least, and they share a band with probability 1 - (1 - 0.19)^64 = 0.999998.
BANDS, ROWS = 64, 1
#: Up to so many shingles of all templates are part of the plan; more are looked up by a join.
MAX_SHINGLES = 20_000

#: Public license notices and texts, name and wording.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "Apache-2.0-header",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License"),
    (
        "MIT-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    (
        "GPL-3.0-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    (
        "BSD-conditions",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "LGPL-2.1-notice",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. "
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    (
        # The notice is the GPL's but for this sentence's license name.
        "AGPL-3.0-notice",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    (
        "MPL-2.0-notice",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "EPL-2.0-notice",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/",
    ),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    (
        "BSD-3-clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission.",
    ),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    (
        "Zlib",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    ),
)


def _shingle(words: Column, at: Column) -> Column:
    return F.xxhash64(F.slice(words, at + 1, F.lit(WIDTH)))


def _places(words: Column) -> Column:
    last = F.size(words) - WIDTH
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _bands(shingles: Column) -> Column:
    """The band hashes of a set: BANDS * ROWS least hashes, ROWS folded into one."""
    least = F.transform(F.sequence(F.lit(0), F.lit(BANDS * ROWS - 1)), lambda k: F.array_min(F.transform(shingles, lambda h: F.xxhash64(k, h))))
    return let(least, lambda mins: F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.slice(mins, b * ROWS + 1, F.lit(ROWS)))))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, license, containment (the best window's share of the template's shingles) and windows (how many hold it).

    Words are A-Z lower-cased runs of letters and digits. Templates fall into classes by their length; a class has
    windows of twice its length at half-window steps, so a template lies whole in one of them. Of a window's shingles
    those that occur in some template make its set (any other shingle can't match). Windows without one are never
    built, so only the scan touches the bulk of the words. Templates of fewer than 5 words can't be found.

    Null and empty texts match nothing. A text is scanned by itself, whatever id it has: rows that repeat a doc_id give one
    row for each license, of the text with the best containment (and the most windows among equals); of the rows without
    doc_id each distinct text gives its own."""
    spark = docs.sparkSession
    named = spark.createDataFrame(list(templates), "license string, body string")
    places = lambda w: F.array_distinct(F.transform(_places(w), lambda i: _shingle(w, i)))
    known = named.select("license", let(word_hashes(F.col("body")), lambda w: F.struct(places(w).alias("of"), F.transform(_places(w), lambda i: F.get(w, i)).alias("heads"))).alias("t"))
    known = known.select("license", F.col("t.of").alias("template"), F.col("t.heads").alias("heads"), F.size("t.of").alias("n")).filter("n > 0")
    known = known.withColumn("class", F.ceil(F.log2("n")).cast("int"))
    classes = sorted(x["class"] for x in known.select("class").distinct().collect())
    few = (known.agg(F.sum("n")).first()[0] or 0) <= MAX_SHINGLES
    body = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("body"))
    row = [F.col("doc_id"), F.xxhash64("body").alias("version")]
    if few:
        parts = known.select("template", "heads").collect()
        vocabulary, heads = sorted({h for p in parts for h in p["template"]}), sorted({h for p in parts for h in p["heads"]})

        def anchors(words: Column) -> Column:
            # The first word rules out most places before anything is hashed.
            here = F.filter(_places(words), lambda i: F.get(words, i).isin(heads) & _shingle(words, i).isin(vocabulary))
            return F.transform(here, lambda i: F.struct(i.alias("at"), _shingle(words, i).alias("h")))

        found = body.select(*row, F.explode(let(word_hashes(F.col("body")), anchors)).alias("a"))
    else:
        every = body.select(*row, F.explode(let(word_hashes(F.col("body")), lambda w: F.transform(_places(w), lambda i: F.struct(i.alias("at"), _shingle(w, i).alias("h"))))).alias("a"))
        found = every.join(known.select(F.explode("template").alias("__h")).distinct(), F.col("a.h") == F.col("__h"), "left_semi")
    found = found.select("doc_id", "version", "a.at", "a.h")
    step = F.pow(F.lit(2), F.col("class")).cast("int")
    dealt = found.withColumn("class", F.explode(F.array(*(F.lit(c) for c in classes)))).withColumn("window", F.floor(F.col("at") / step))
    dealt = dealt.withColumn("window", F.explode(F.array(F.col("window"), F.col("window") - 1)))
    windows = dealt.groupBy("doc_id", "version", "class", "window").agg(F.collect_set("h").alias("shingles"))
    banded = windows.withColumn("band", F.explode(_bands(F.col("shingles"))))
    keyed = known.select("license", "template", "n", "class", F.explode(_bands(F.col("template"))).alias("band"))
    # MAX_SHINGLES bounds the templates, and so their BANDS rows each.
    matched = banded.join(F.broadcast(keyed) if few else keyed, ["class", "band"])
    share = matched.select("doc_id", "version", "license", "window", (F.size(F.array_intersect("shingles", "template")) / F.col("n")).alias("containment"))
    held = share.filter(F.col("containment") >= least).groupBy("doc_id", "version", "license").agg(F.max("containment").alias("containment"), F.count_distinct("window").alias("windows"))
    best = held.groupBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("version")).alias("own"), "license").agg(F.max(F.struct("containment", "windows")).alias("best"))
    return best.select("doc_id", "license", "best.containment", "best.windows")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licenses in all documents, one row for each document and license; see scan for nulls and repeated rows."""
    return scan(table(spark, sf_dir, "documents"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Plain containment in every window, without bands.
ORACLE_SQL = rf"""
WITH given AS (SELECT * FROM (VALUES {", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in TEMPLATES)}) AS v(license, body)),
split AS (
  SELECT license AS key, NULL AS doc_id, body FROM given UNION ALL SELECT NULL, doc_id, coalesce(text, '') FROM documents),
words AS (
  SELECT key, doc_id, md5(body) AS version, list_filter(string_split_regex(translate(body, '{UPPER}', '{LOWER}'), '{BREAK}'), lambda w: w <> '') AS w FROM split),
shingles AS (
  SELECT key, doc_id, version, i - 1 AS at, array_to_string(list_slice(w, i, i + {WIDTH - 1}), ' ') AS s
  FROM (SELECT key, doc_id, version, w, unnest(range(1, len(w) - {WIDTH - 2})) AS i FROM words WHERE len(w) >= {WIDTH})),
templates AS (SELECT DISTINCT key AS license, s FROM shingles WHERE key IS NOT NULL),
sized AS (SELECT license, count(*) AS n, CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) AS step FROM templates GROUP BY license),
windows AS (
  SELECT h.doc_id, h.version, t.license, h.at // z.step - k.v AS win, count(DISTINCT h.s) / any_value(z.n) AS containment
  FROM shingles h JOIN templates t ON t.s = h.s JOIN sized z ON z.license = t.license CROSS JOIN (VALUES (0), (1)) AS k(v)
  WHERE h.key IS NULL GROUP BY ALL),
held AS (
  SELECT doc_id, version, license, max(containment) AS containment, count(*) AS windows FROM windows WHERE containment >= {LEAST} GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, CASE WHEN doc_id IS NULL THEN version END, license ORDER BY containment DESC, windows DESC) AS k FROM held)
SELECT doc_id, license, containment, windows FROM ranked WHERE k = 1
"""
