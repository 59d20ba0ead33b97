"""License scan: TF-IDF cosine of headers and license files to templates, and
inheritance from the nearest directory above. DataFrame operations only.

A file's headers are its lines, wherever they stand; its whole text is compared
too. A segment's terms weigh term frequency times ``ln((1 + N) / (1 + df)) + 1``
with document frequencies over all N files (a term in no template counts as
df = 0). The best template of a segment with a cosine of ``MIN_COSINE`` or more
names its license; ties go to the smaller license name. The file's own license
is that of its best segment. A file with a license is a license file if its whole
text matches or its name says so (``NAMES``): it names the license of its
directory, and a file without a license of its own takes that of the nearest
directory at or above its own (the best match there; ties go to the smaller file
path, then the license).

Only segments with a key term are scored. A template's key terms are its
heaviest ones up to where the rest of its norm is below ``MIN_COSINE``; by
Cauchy and Schwarz a segment without one can't reach that cosine, so nothing is
lost. What the driver sees are N and the document frequencies of the templates'
terms, as many whatever the input.

Rows: a null or empty text has no segments; a null path has no directory and
inherits nothing. Repeated rows each get their row. Only id, path and text are
read. Licenses of directories are found per directory, not per file, so a
directory of any number of files takes one row.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common

MIN_COSINE = 0.7

# Customary notices by SPDX name.
TEMPLATES: list[tuple[str, str]] = [
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under "
                 "the terms of the GNU Affero General Public License as published by the Free "
                 "Software Foundation, either version 3 of the License, or any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not "
                   "use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without "
                     "modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International "
                  "License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial "
                     "4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and "
                "related or neighboring rights to this work. CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under "
                "the terms of the GNU General Public License as published by the Free Software "
                "Foundation, either version 3 of the License, or any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose "
            "with or without fee is hereby granted"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
            "software and associated documentation files, to deal in the Software without "
            "restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, "
                "v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Proprietary and confidential. Unauthorized copying is strictly prohibited."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

# Fixed value: names of files that hold licenses.
NAMES = r"(^|/)(LICEN[CS]E|COPYING|NOTICE|UNLICENSE)[^/]*$"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


# The other ASCII characters, all that no term has.
_BLANKS = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def terms(text: Column) -> Column:
    """Matches of ``_TERM`` in order, A-Z lower-cased. Blanks in place of what ends a term
    and a split at them take a fraction of the time of a regular expression."""
    blanked = F.translate(text, _UPPER + _BLANKS, _LOWER + " " * len(_BLANKS))
    return F.array_remove(F.split(blanked, " "), "")


def template_terms() -> list[Counter]:
    return [Counter(re.findall(_TERM, text.lower())) for _, text in TEMPLATES]


def idf(n: int, df: int) -> float:
    return math.log((1 + n) / (1 + df)) + 1


def weigh(n: int, df: dict[str, int]) -> tuple[list[dict[str, float]], set[str]]:
    """Unit vectors of the templates, and all key terms."""
    vectors, keys = [], set()
    for counts in template_terms():
        w = {t: c * idf(n, df.get(t, 0)) for t, c in counts.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        vectors.append({t: x / norm for t, x in w.items()})
        left = 1.0
        for t, x in sorted(vectors[-1].items(), key=lambda p: (-p[1], p[0])):
            if left < (MIN_COSINE * 0.999) ** 2:
                break
            keys.add(t)
            left -= x * x
    return vectors, keys


def _values(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A small constant table, as SQL VALUES."""
    sql = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else
                                    f"{v!r}D" if isinstance(v, float) else str(v)
                                    for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {sql} AS t({names})")


def scan(files: DataFrame, file_id: str = "doc_id", path: str = "path",
         text: str = "text") -> DataFrame:
    """``file_id, path, license, origin, cosine, license_path`` of every row.
    ``origin`` is header, file, inherited or null; ``license_path`` the file that
    the license was found in."""
    spark = files.sparkSession
    rows = files.select(F.col(file_id).alias("file_id"), F.col(path).alias("path"),
                        F.col(text).alias("text"))
    vocabulary = sorted({t for c in template_terms() for t in c})
    known = F.array(*map(F.lit, vocabulary))
    counted = rows.select(F.array_intersect(F.coalesce(terms(F.col("text")), F.array()), known)
                          .alias("t"))
    # one more term stands for the files themselves
    df = {r.term: r.n for r in counted.select(
        F.explode(F.concat("t", F.array(F.lit("")))).alias("term"))
        .groupBy("term").agg(F.count("*").alias("n")).collect()}
    n = df.pop("", 0)
    vectors, keys = weigh(n, df)
    key = F.array(*map(F.lit, sorted(keys)))

    # segments with a key term: lines, and the whole text as number -1
    marked = rows.where(F.arrays_overlap(terms(F.col("text")), key)) \
        .select("file_id", "path", F.xxhash64("text").alias("h"), F.explode(F.concat(
            F.array(F.struct(F.lit(-1).alias("line"), F.col("text").alias("t"))),
            F.transform(F.split("text", "\n"),
                        lambda x, i: F.struct(i.cast("int").alias("line"), x.alias("t"))))
        ).alias("s")).select("file_id", "path", "h", "s.line", terms(F.col("s.t")).alias("words")) \
        .where(F.arrays_overlap("words", key))
    # rows that repeat id, path and text have the same segments
    own = ["file_id", "path", "h"]
    one = marked.groupBy(*own, "line").agg(F.first("words").alias("words"))
    counts = one.select(*own, "line", F.explode("words").alias("term")) \
        .groupBy(*own, "line", "term").agg(F.count("*").alias("tf"))
    idfs = _values(spark, [(t, idf(n, df.get(t, 0))) for t in vocabulary], "term, idf")
    weights = _values(spark, [(i, TEMPLATES[i][0], t, w) for i, v in enumerate(vectors)
                              for t, w in sorted(v.items())], "template, name, term, unit")
    weighed = counts.join(F.broadcast(idfs), "term", "left").withColumn(
        "w", F.col("tf") * F.coalesce("idf", F.lit(idf(n, 0))))
    norms = weighed.groupBy(*own, "line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(F.broadcast(weights), "term") \
        .groupBy(*own, "line", "template", "name").agg(F.sum(F.col("w") * F.col("unit")).alias("dot"))
    same = lambda a, b, names: [a[c].eqNullSafe(b[c]) for c in names]
    scored = dots.join(norms, same(dots, norms, [*own, "line"])) \
        .select(*(dots[c] for c in own), dots["line"], "name",
                F.round(F.col("dot") / F.col("norm"), 9).alias("cosine")) \
        .where(F.col("cosine") >= MIN_COSINE)
    best = F.max_by(F.struct("name", "cosine", "line"),
                    F.struct("cosine", F.col("line") < 0, _reversed("name"), -F.col("line")))
    matched = common.staged(scored.groupBy(*own).agg(best.alias("m"))
                            .select(*own, "m.name", "m.cosine", ((F.col("m.line") < 0) | F.coalesce(
                                F.col("path").rlike(f"(?i){NAMES}"), F.lit(False))).alias("file")))

    # licenses of directories, and the nearest one at or above each directory
    directory = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    inside = matched.where("file and path is not null") \
        .groupBy(directory.alias("dir")) \
        .agg(F.min_by(F.struct("name", "path"), F.struct(-F.col("cosine"), "path", "name"))
             .alias("given"))
    dirs = rows.where("path is not null").select(directory.alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("up"))))
        .alias("a")).select("dir", "a.depth", "a.up")
    near = above.join(inside.withColumnRenamed("dir", "up"), "up") \
        .groupBy("dir").agg(F.max_by("given", "depth").alias("given"))

    keyed = rows.select("file_id", "path", F.xxhash64("text").alias("h"), directory.alias("dir"))
    found = keyed.join(matched, same(keyed, matched, own), "left") \
        .select(*(keyed[c] for c in ("file_id", "path", "dir")), "name", "cosine", "file") \
        .join(near, "dir", "left")
    return found.select(
        "file_id", "path", F.coalesce("name", "given.name").alias("license"),
        F.when(F.col("name").isNotNull(), F.when(F.col("file"), "file").otherwise("header"))
        .when(F.col("given").isNotNull(), "inherited").alias("origin"),
        F.round("cosine", 6).alias("cosine"),
        F.when(F.col("name").isNotNull(), F.col("path")).otherwise(F.col("given.path"))
        .alias("license_path"))


def _reversed(name: str) -> Column:
    """Order of the fixed license names, the smaller first, for a maximum."""
    names = sorted({n for n, _ in TEMPLATES})
    return -F.array_position(F.array(*map(F.lit, names)), F.col(name))


def document_path() -> Column:
    """Documents have no path: the digits of the id are folders, and an id that
    ends in 0 is the license file of the folder before."""
    digits = F.col("doc_id").cast("string")
    return F.concat_ws("/", F.lit("corpus"), F.regexp_replace(
        F.array_join(F.split(digits, "(?<=.)(?=.)"), "/"), "/0$", "/LICENSE"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = common.table(spark, sf_dir, "documents") \
        .select("doc_id", document_path().alias("path"), "text")
    return scan(files).withColumnRenamed("file_id", "doc_id")


def _sql() -> str:
    """The same scores for every line, without key terms."""
    words = f"regexp_extract_all(translate(coalesce(%s, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}')"
    templates = ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(TEMPLATES))
    return f"""
WITH tpl AS (SELECT * FROM (VALUES {templates}) v(template, name, t)),
tt AS (SELECT template, name, term, count(*) AS tf FROM (
         SELECT template, name, unnest({words % 't'}) AS term FROM tpl) GROUP BY ALL),
f AS (SELECT doc_id, text, 'corpus/' || regexp_replace(array_to_string(string_split(
        CAST(doc_id AS VARCHAR), ''), '/'), '/0$', '/LICENSE') AS path FROM documents),
n AS (SELECT count(*) AS n FROM f),
df AS (SELECT term, count(*) AS df FROM (
         SELECT DISTINCT doc_id, unnest({words % 'text'}) AS term FROM f)
       WHERE term IN (SELECT term FROM tt) GROUP BY term),
idf AS (SELECT DISTINCT tt.term, ln((1 + n) / (1 + coalesce(df, 0))) + 1 AS idf
        FROM tt CROSS JOIN n LEFT JOIN df USING (term)),
tw AS (SELECT template, name, term,
              tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS unit
       FROM tt JOIN idf USING (term)),
seg AS (SELECT doc_id, path, -1 AS line, text AS t FROM f UNION ALL
        SELECT doc_id, path, line - 1, t FROM (
          SELECT doc_id, path, generate_subscripts(l, 1) AS line, unnest(l) AS t
          FROM (SELECT doc_id, path, string_split(text, chr(10)) AS l FROM f))),
st AS (SELECT doc_id, path, line, term, count(*) AS tf FROM (
         SELECT doc_id, path, line, unnest({words % 't'}) AS term FROM seg) GROUP BY ALL),
sw AS (SELECT st.*, tf * coalesce(idf, ln(1 + n) + 1) AS w
       FROM st CROSS JOIN n LEFT JOIN idf USING (term)),
norm AS (SELECT doc_id, line, sqrt(sum(w * w)) AS norm FROM sw GROUP BY ALL),
cos AS (SELECT doc_id, path, line, name, round(sum(w * unit) / any_value(norm), 9) AS cosine
        FROM sw JOIN tw USING (term) JOIN norm USING (doc_id, line)
        GROUP BY doc_id, path, line, template, name),
m AS (SELECT * FROM cos WHERE cosine >= {MIN_COSINE}
      QUALIFY row_number() OVER (PARTITION BY doc_id
        ORDER BY cosine DESC, line >= 0, name, line) = 1),
mf AS (SELECT *, line < 0 OR regexp_matches(path, '(?i){NAMES}') AS file FROM m),
inside AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS up, name, path FROM mf WHERE file
           QUALIFY row_number() OVER (PARTITION BY up ORDER BY cosine DESC, path, name) = 1),
near AS (SELECT f.doc_id, i.name, i.path FROM f JOIN inside i
           ON starts_with(regexp_extract(f.path, '^(.*)/[^/]*$', 1) || '/', i.up || '/')
         QUALIFY row_number() OVER (PARTITION BY f.doc_id ORDER BY length(i.up) DESC) = 1)
SELECT f.doc_id, f.path, coalesce(m.name, near.name) AS license,
       CASE WHEN m.name IS NOT NULL THEN CASE WHEN m.file THEN 'file' ELSE 'header' END
            WHEN near.name IS NOT NULL THEN 'inherited' END AS origin,
       round(m.cosine, 6) AS cosine,
       CASE WHEN m.name IS NOT NULL THEN f.path ELSE near.path END AS license_path
FROM f LEFT JOIN mf m USING (doc_id) LEFT JOIN near USING (doc_id)
"""


OP10_SQL = _sql()
