"""License scans in DataFrame operations only: notices by TF-IDF cosine to templates, then inheritance by directory.

Every line of a file is a possible notice, and so is every block (a run of lines up to a blank line, or up to one
without letters and digits) and the text as a whole, since notices are wrapped.  Blocks are compared to titles with
versions as well, which stand in two lines.  Common words don't count.  Tests, each dearer than the one before, drop
what can't match, and none drops a match: a text, and a unit, whose cosine to a template reaches the threshold holds one
of the tokens without which the template's others are too light; the unit shares two of its tokens and a large enough
part of it; and its cosine stays high enough when every token that no template knows counts only once.  A single shared
token is no notice.  A file without a notice of its own takes the license of the nearest directory
above it that has a license file with a notice: each directory is joined to its ancestors by path, then files to their
directories.
"""

from __future__ import annotations

import json
import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import query, table, text_or_empty
from eventlens.session import materialise

THRESHOLD = 0.6
#: Short notices, standard headers and identifiers of common licenses.
TEMPLATES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted."),
    ("ISC", "ISC License"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Heads of license files, a title and a version in lines of their own, the version with its date or without: compared to what has more than one line.
TITLES = (
    ("AGPL-3.0", "GNU Affero General Public License Version 3"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-2.0", "GNU General Public License Version 2"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License Version 3"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
)
LICENSE_FILES = ("LICENSE", "LICENCE", "COPYING", "LICENSE.txt", "LICENCE.txt", "LICENSE.md", "COPYING.txt")
#: Common English words, which are no tokens.
COMMON_WORDS = (
    "the of and to in a is that for it as with on be by are this or from at an was not have which you were all their there use no any into"
).split()
TOKEN = "[a-z0-9]+"
_MAX_TEMPLATES = 2000


def _tokens(text: str) -> list[str]:
    return [t for t in re.findall(TOKEN, text.lower()) if t not in COMMON_WORDS]


class _Weights:
    """Unit vectors of the templates, and the tokens of which a matching text has one.

    Titles are numbered after the templates and don't count for the inverse frequencies.
    """

    def __init__(self, templates, threshold: float, titles=()):
        if len(templates) > _MAX_TEMPLATES:
            raise ValueError(f"at most {_MAX_TEMPLATES} templates")
        tokens = [_tokens(text) for _, text in templates]
        seen = {t for ts in tokens for t in ts}
        self.unknown = math.log(1 + len(templates)) + 1
        self.idf = {t: math.log((1 + len(templates)) / (1 + sum(t in ts for ts in tokens))) + 1 for t in sorted(seen)}
        tokens += [_tokens(text) for _, text in titles]
        self.idf |= {t: self.unknown for ts in tokens for t in ts if t not in seen}
        self.rows, self.needed = [], set()
        for number, ((name, _), ts) in enumerate(zip([*templates, *titles], tokens)):
            vector = {t: ts.count(t) * self.idf[t] for t in set(ts)}
            norm = math.sqrt(sum(v * v for v in vector.values()))
            # tokens that a match can do without: as many as stay under the threshold together, those in most templates first
            spare = threshold**2 * (1 - 1e-9)
            for t, v in sorted(vector.items(), key=lambda x: (self.idf[x[0]], x[0])):
                self.rows.append((number, name, t, v / norm))
                if (v / norm) ** 2 < spare:
                    spare -= (v / norm) ** 2
                else:
                    self.needed.add(t)

    def pattern(self) -> str:
        """Any of the needed tokens, by first letter, so that most words are passed over after one look."""
        first: dict[str, list[str]] = {}
        for t in sorted(self.needed):
            first.setdefault(t[0], []).append(t[1:])
        return "(?i)(?<![a-z0-9])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in first.items()) + ")(?![a-z0-9])"

    def vectors(self, value) -> Column:
        """Map of each token to an array of ``value(weight, idf)`` by template, zero where the template lacks it."""
        out = {t: [0.0] * self.size for t in self.idf}
        for number, _, t, w in self.rows:
            out[t][number] = value(w, self.idf[t])
        return F.from_json(F.lit(json.dumps(out)), "map<string, array<double>>")

    @property
    def size(self) -> int:
        return self.rows[-1][0] + 1 if self.rows else 0

    def names(self) -> Column:
        return F.split(F.lit(",".join(dict((n, name) for n, name, *_ in self.rows).values())), ",")


def _texts(text: Column) -> Column:
    """The lines, blocks and whole of a text, each once."""
    return F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, "\n\\s*\n"), F.split(text, "\n[^A-Za-z0-9]*\n"), F.array(text)))


def _squares(tokens: Column) -> Column:
    """Sum of the squared counts of an array's tokens, by its runs when sorted."""
    state = lambda last, n, total: F.struct(last.alias("last"), n.alias("n"), total.alias("total"))
    begin = state(F.lit(""), F.lit(0.0), F.lit(0.0))
    step = lambda s, t: F.when(s["last"] == t, state(t, s["n"] + 1, s["total"])).otherwise(state(t, F.lit(1.0), s["total"] + s["n"] * s["n"]))
    return F.aggregate(F.sort_array(tokens), begin, step, lambda s: s["total"] + s["n"] * s["n"])


def notices(files: DataFrame, text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD, titles=TITLES) -> DataFrame:
    """(text_hash, license, score): the best notice of each text that has one (highest score, then license)."""
    weights = _Weights(templates, threshold, titles)
    known, needed = (F.array(*[F.lit(t) for t in sorted(x)]) for x in (weights.idf, weights.needed))
    idf = F.create_map(*[F.lit(x) for pair in weights.idf.items() for x in pair])
    squares, pulls = weights.vectors(lambda w, _: w * w), weights.vectors(lambda w, i: w * i)
    none = F.array_repeat(F.lit(0.0), weights.size)
    # each step's result comes out of a generator, so that the next ones don't repeat it
    stored = lambda value, name: F.explode(F.array(value)).alias(name)
    # the largest part of a template's square that the tokens of an array make up
    shared = lambda present: F.array_max(F.aggregate(present, none, lambda total, t: F.zip_with(total, F.element_at(squares, t), lambda a, b: a + b)))
    spelled = F.trim(F.lower(F.regexp_replace("content", "[^A-Za-z0-9]+", " ")))
    common = F.array(*[F.lit(t) for t in COMMON_WORDS])
    units = (
        files.where(F.col(text_col).rlike(weights.pattern()))
        .select(F.xxhash64(text_col).alias("text_hash"), F.explode(_texts(F.col(text_col))).alias("content"))
        .select("text_hash", F.contains(F.col("content"), F.lit("\n")).alias("wrapped"), stored(F.split(spelled, " "), "tokens"))
        .where(F.arrays_overlap("tokens", needed))
        .select("*", stored(F.array_intersect("tokens", known), "present"))
        .where(F.size("present") > 1)
        .where(shared("present") >= F.lit(threshold**2 * (1 - 1e-6)))
    )
    times = lambda t: F.size("tokens") - F.size(F.array_remove("tokens", t))
    square = lambda x: F.pow(x, F.lit(2.0))
    content = F.filter("tokens", lambda t: ~F.array_contains(common, t))
    counted = units.select("text_hash", "wrapped", stored(content, "tokens"), "present").select("text_hash", "wrapped", "tokens", stored(F.map_from_arrays("present", F.transform("present", times)), "counts"))
    known2 = F.aggregate(F.map_entries("counts"), F.lit(0.0), lambda total, s: total + square(s["value"] * F.element_at(idf, s["key"])))
    others = F.size("tokens") - F.aggregate(F.map_values("counts"), F.lit(0), lambda total, n: total + n)
    dots = F.aggregate(F.map_entries("counts"), none, lambda total, s: F.zip_with(total, F.element_at(pulls, s["key"]), lambda a, b: a + s["value"] * b))
    hits = F.aggregate(F.map_keys("counts"), none, lambda total, t: F.zip_with(total, F.element_at(pulls, t), lambda a, b: a + F.signum(b)))
    measured = counted.select("text_hash", "wrapped", "tokens", F.inline(F.array(F.struct(
        known2.alias("known2"), others.alias("others"), dots.alias("dots"), hits.alias("hits")))))

    def best(others2: Column) -> Column:
        """Least (minus the cosine, license) of the templates; titles are for wrapped units, and one shared token is no notice."""
        norm = F.sqrt(F.col("known2") + others2 * weights.unknown**2)
        able = lambda i: (F.element_at("hits", i + 1) > 1) & (F.col("wrapped") | (i < len(templates)))
        return F.array_min(F.transform("dots", lambda d, i: F.struct(
            F.when(able(i), -F.round(d / norm, 6)).otherwise(F.lit(0.0)).alias("minus"), F.element_at(weights.names(), i + 1).alias("license"))))

    # with every other token counted once a unit is at its shortest: its cosine can only be lower
    likely = measured.select("*", stored(best(F.col("others")), "bound")).where(F.col("bound.minus") <= -threshold + 1e-6)
    exact = likely.select("text_hash", stored(best(_squares(F.filter("tokens", lambda t: ~F.array_contains(known, t)))), "best"))
    found = exact.where(F.col("best.minus") <= -threshold).groupBy("text_hash").agg(F.min("best").alias("best"))
    return found.select("text_hash", F.col("best.license").alias("license"), (-F.col("best.minus")).alias("score"))


def _directory(path: Column) -> Column:
    """Path up to the last slash; the root directory is empty."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan_licenses(files: DataFrame, path_col: str = "path", text_col: str = "text", templates=TEMPLATES,
                  threshold: float = THRESHOLD, license_files=LICENSE_FILES) -> DataFrame:
    """``files`` with header_license, header_score, inherited_license, inherited_from (a directory) and license.

    A file without a notice of its own takes that of the nearest directory above it whose license file has one (of
    several there, the highest score, then path).  A null text has no notice, a null path no directory.  Columns of
    ``files`` with these names are replaced.
    """
    added = ["header_license", "header_score", "inherited_license", "inherited_from", "license"]
    own = files.drop(*added)
    # read twice below, found once: one row per distinct text with a notice
    found = materialise(notices(own, text_col, templates, threshold)).select(
        F.col("text_hash").alias("_hash"), F.col("license").alias("header_license"), F.col("score").alias("header_score"))
    marked = (
        own.withColumn("_hash", F.xxhash64(text_col)).withColumn("_directory", _directory(F.col(path_col)))
        .join(found, "_hash", "left").drop("_hash")
    )
    licensed = (
        marked.where(F.col("header_license").isNotNull() & F.element_at(F.split(path_col, "/"), -1).isin(*license_files))
        .groupBy(F.col("_directory").alias("inherited_from"))
        .agg(F.min(F.struct((-F.col("header_score")).alias("minus"), F.col(path_col).alias("path"), F.col("header_license").alias("license"))).alias("best"))
        .select("inherited_from", F.col("best.license").alias("inherited_license"))
    )
    parts = F.split("_directory", "/")
    above = F.when(F.col("_directory") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))))
    nearest = (
        own.select(_directory(F.col(path_col)).alias("_directory")).where("_directory IS NOT NULL").distinct()
        .select("_directory", F.posexplode(above).alias("depth", "inherited_from"))
        .join(licensed, "inherited_from")
        .groupBy("_directory").agg(F.max(F.struct("depth", "inherited_from", "inherited_license")).alias("near"))
        .select("_directory", "near.inherited_from", "near.inherited_license")
    )
    inherits = F.col("header_license").isNull()
    return (
        marked.join(nearest, "_directory", "left").drop("_directory")
        .withColumn("inherited_license", F.when(inherits, F.col("inherited_license")))
        .withColumn("inherited_from", F.when(inherits, F.col("inherited_from")))
        .withColumn("license", F.coalesce("header_license", "inherited_license"))
    )


def document_path(id_col: str = "doc_id") -> Column:
    """A path for each document: directories of 100, 1,000 and 10,000 ids, of which the first holds the license file."""
    i = F.col(id_col)
    name = F.when(i % 100 == 0, F.lit("LICENSE")).otherwise(F.concat(i.cast("string"), F.lit(".txt")))
    levels = [F.concat(F.lit(letter), F.floor(i / size).cast("string")) for letter, size in (("a", 10_000), ("b", 1_000), ("c", 100))]
    folder = F.when(i % 10_000 == 0, levels[0]).when(i % 1_000 == 0, F.concat_ws("/", *levels[:2])).otherwise(F.concat_ws("/", *levels))
    return F.concat_ws("/", folder, name)


def _templates_sql(rows, first: int = 0) -> str:
    return ", ".join(f"({n}, '{name}', '{text}')" for n, (name, text) in enumerate(rows, first))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op4_license_scan", sql=f"""WITH templates AS (SELECT * FROM (VALUES {_templates_sql(TEMPLATES)}) v(template, license, text)),
titles AS (SELECT * FROM (VALUES {_templates_sql(TITLES, len(TEMPLATES))}) v(template, license, text)),
template_tokens AS (SELECT * FROM (SELECT template, license, unnest(regexp_extract_all({_LOWER.format('text')}, '{TOKEN}')) AS token FROM (FROM templates UNION ALL FROM titles))
  WHERE token NOT IN ({', '.join(f"'{t}'" for t in COMMON_WORDS)})),
idf AS (SELECT token, ln((1 + {len(TEMPLATES)}) / (1 + count(DISTINCT template) FILTER (template < {len(TEMPLATES)}))::DOUBLE) + 1 AS idf FROM template_tokens GROUP BY 1),
raw AS (SELECT template, license, token, count(*) * any_value(idf) AS v FROM template_tokens JOIN idf USING (token) GROUP BY 1, 2, 3),
weights AS (SELECT template, license, token, v / sqrt(sum(v * v) OVER (PARTITION BY template)) AS weight FROM raw),
files AS (SELECT row_number() OVER () AS r, doc_id, text, CASE WHEN doc_id % 100 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END AS name,
  'a' || (doc_id // 10000) AS a, 'a' || (doc_id // 10000) || '/b' || (doc_id // 1000) AS b,
  'a' || (doc_id // 10000) || '/b' || (doc_id // 1000) || '/c' || (doc_id // 100) AS c FROM documents),
placed AS (SELECT *, CASE WHEN doc_id % 10000 = 0 THEN a WHEN doc_id % 1000 = 0 THEN b ELSE c END AS directory FROM files),
units AS (SELECT r, list_distinct(string_split(t, chr(10)) || regexp_split_to_array(t, '\\n[ \\t\\n\\x0B\\f\\r]*\\n') || regexp_split_to_array(t, '\\n[^A-Za-z0-9]*\\n') || [t]) AS l
  FROM (SELECT r, coalesce(text, '') AS t FROM files)),
lines AS (SELECT r, generate_subscripts(l, 1) AS line, unnest(l) AS content FROM units),
tokens AS (SELECT r, line, wrapped, token, count(*) AS n
  FROM (SELECT r, line, contains(content, chr(10)) AS wrapped, unnest(regexp_extract_all({_LOWER.format('content')}, '{TOKEN}')) AS token FROM lines)
  WHERE token NOT IN ({', '.join(f"'{t}'" for t in COMMON_WORDS)}) GROUP BY 1, 2, 3, 4),
own AS (SELECT r, line, wrapped, token, n * coalesce(idf, ln(1 + {len(TEMPLATES)}) + 1) AS v FROM tokens LEFT JOIN idf USING (token)),
norms AS (SELECT r, line, sqrt(sum(v * v)) AS norm FROM own GROUP BY 1, 2),
scores AS (SELECT o.r, o.line, w.template, w.license, round(sum(o.v * w.weight) / any_value(m.norm), 6) AS score
  FROM own o JOIN weights w USING (token) JOIN norms m ON m.r = o.r AND m.line = o.line
  WHERE o.wrapped OR w.template < {len(TEMPLATES)} GROUP BY 1, 2, 3, 4 HAVING count(*) > 1),
headers AS (SELECT r, license AS header_license, score AS header_score FROM scores WHERE score >= {THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, license) = 1),
marked AS (SELECT * FROM placed LEFT JOIN headers USING (r)),
licensed AS (SELECT directory, header_license FROM marked WHERE name = 'LICENSE' AND header_license IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY directory ORDER BY header_score DESC, directory || '/' || name, header_license) = 1)
SELECT m.doc_id, directory || '/' || name AS path, m.header_license, m.header_score,
  CASE WHEN m.header_license IS NULL THEN coalesce(lc.header_license, lb.header_license, la.header_license) END AS inherited_license,
  CASE WHEN m.header_license IS NULL THEN coalesce(lc.directory, lb.directory, la.directory) END AS inherited_from,
  coalesce(m.header_license, lc.header_license, lb.header_license, la.header_license) AS license
FROM (SELECT * RENAME (directory AS dir) FROM marked) m
LEFT JOIN licensed la ON la.directory = m.a LEFT JOIN licensed lb ON lb.directory = m.b AND m.dir <> m.a
LEFT JOIN licensed lc ON lc.directory = m.c AND m.dir = m.c""".replace("SELECT m.doc_id, directory || '/' || name AS path", "SELECT m.doc_id, m.dir || '/' || m.name AS path"))
def op4(spark, d):
    """License of every document, its own or inherited."""
    files = table(spark, d, "documents").select("doc_id", document_path().alias("path"), text_or_empty().alias("text"))
    return scan_licenses(files).select("doc_id", "path", "header_license", "header_score", "inherited_license", "inherited_from", "license")
