"""Licence scan with DataFrame functions only.

Three kinds of parts of a text are sparse TF-IDF vectors over their words: its lines, the windows of as
many words as a notice has (so that a notice is found inside a longer line or over line ends), and its
blocks: the header (the leading comment, or else the first paragraph) and, of a licence file, the whole
text. Lines and blocks are compared with notices, titles and full licence texts, a window with the
notice of its length. Titles, long notices and full texts have
idf values of their own, and no common words. The cosines come from
one join with the templates' terms, a table whose size is that of the template list.

Only parts with anchor words are compared, which drops no match: the shares of a group of a template's
anchors have squares of more than 1 - threshold ** 2 together, so the cosine of a part without any word
of the group is under the threshold (Cauchy-Schwarz). A part needs a word of each group of a template.
By the same bound a window is only written out if the squared shares of its words add up to threshold ** 2.
Texts are read once for all kinds of parts.

The best part of a file at or over the threshold gives its licence. Files without one inherit
it from the nearest ancestor directory that holds a licence file: distinct directories are
expanded to their ancestors and joined by path, then files join their directory.

Defined results: a null text or path has no lines and no directory; a file without an id is a file like
others; rows of one id are files of their own (rows are told apart by 96 bits of hashes of id, path and
text); very long texts are read whole; a file's own licence goes before an inherited one; a block that matches a full text goes before notices (a BSD text has the line "All
rights reserved."); ties go to the smaller licence id; of several licence files of a directory the
best match counts (ties: smaller licence id); repeated rows are kept; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize

# Short standard notices of well-known licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "CC-BY-4.0": "Licensed under CC BY 4.0. Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
# Longer notices: looked for in windows as well.
NOTICES = {
    "GPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0 notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "MIT notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
}
# Titles: only whole lines and blocks are compared with them, and need all their words ("mit" alone is a German word).
TITLES = {
    "Apache-2.0 title": "Apache License Version 2.0, January 2004",
    "BSD-3-Clause title": "BSD 3-Clause License",
    "CC-BY-4.0 title": "Creative Commons Attribution 4.0 International Public License",
    "CC-BY-NC-4.0 title": "Creative Commons Attribution-NonCommercial 4.0 International Public License",
    "GPL-3.0 title": "GNU General Public License Version 3, 29 June 2007",
    "ISC title": "ISC License",
    "LGPL-3.0 title": "GNU Lesser General Public License Version 3, 29 June 2007",
    "MIT title": "MIT License",
    "MIT long title": "The MIT License (MIT)",
    "MPL-2.0 title": "Mozilla Public License Version 2.0",
}
FULL = ("Apache-2.0", "BSD-3-Clause", "GPL-3.0", "ISC", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense")  # licence_texts/
COMMON = set("a all an and any are as at be been but by can do each for from has have if in into is it its may no not of on only or other our shall such than that the their this to under use was which will with without you your".split())  # not in the vectors of notices, titles and full texts; anchors of TEMPLATES only where others don't do
COMMENT = r"^\s*(#|//|--|;|%|\*|/\*|$)"
MARKERS = "licen[sc]e|copyright|permission|redistribut|reserved|public domain|creative commons"  # of scan_sql
WORD = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
THRESHOLD = 0.8


def words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def weights(templates: dict[str, str], without: frozenset | set = frozenset()) -> tuple[list[tuple[str, float, str, float]], dict[str, float], float]:
    """(term, idf, template, share of its unit vector); idf by term; idf of other words."""
    counts = {k: Counter(w for w in words(t) if w not in without) for k, t in templates.items()}
    n = len(counts)
    df = Counter(w for c in counts.values() for w in c)
    idf = {w: round(math.log((1 + n) / (1 + d)) + 1, 6) for w, d in df.items()}
    rows = []
    for k, c in counts.items():
        norm = math.sqrt(sum((f * idf[w]) ** 2 for w, f in c.items()))
        rows += [(w, idf[w], k, round(f * idf[w] / norm, 9)) for w, f in sorted(c.items())]
    return rows, idf, round(math.log(1 + n) + 1, 6)


def is_licence_file(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), "([^/]*)$", 1).rlike("^(un)?licen[sc]e|^copying")


def parent(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def full_texts() -> dict[str, str]:
    folder = resources.files("tessera.llm") / "licence_texts"
    return {f"{k} text": (folder / f"{k}.txt").read_text(encoding="utf-8") for k in FULL}


def anchors(rows: list[tuple[str, float, str, float]], threshold: float) -> dict[str, list[list[str]]]:
    """Groups of words of each template; a text whose cosine is at or over the threshold has one of each."""
    out: dict[str, list[list[str]]] = {}
    for k in dict.fromkeys(r[2] for r in rows):
        held, group, out[k] = 0.0, [], []
        for w, _, _, share in sorted((r for r in rows if r[2] == k), key=lambda r: (r[0] in COMMON, -r[3], r[0])):
            held += share * share
            group.append(w)
            if held > 1 - threshold**2 + 1e-5:  # scores are rounded
                out[k].append(group)
                held, group = 0.0, []
    return out


def one_of(found: list[str]) -> str:
    """Pattern of the words, by first character, in a lower-case text after a space: it begins with what stands
    before a word, which is found faster than by looking back from every character."""
    by: dict[str, list[str]] = {}
    for w in sorted(set(found)):
        by.setdefault(w[0], []).append(re.escape(w[1:]).replace("\\-", "-"))
    return "[^a-z0-9](?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by.items()) + ")(?![a-z0-9])"


# The conditions on words are long, and are SQL texts: these are built and parsed much faster than as Columns.


def words_of(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{WORD}', 0)"


def any_of(held: str, some: list[str]) -> str:
    return f"arrays_overlap({held}, split('{' '.join(some)}', ' '))"  # words of WORD have neither spaces nor quotes


def every_group(held: str, groups: list[list[str]]) -> str:
    return "(" + " AND ".join(any_of(held, g) for g in groups) + ")"


def may_match(text: str, found: dict[str, list[list[str]]]) -> str:
    """Whether a text has a word of each group of some template. Only texts with a word of a first group
    are cut into words, once."""
    first = one_of([w for groups in found.values() for w in groups[0]])
    some = " OR ".join(every_group("held", groups) for groups in found.values())
    return f"(concat(' ', lower({text})) RLIKE r'{first}' AND exists(array(array_distinct({words_of(text)})), held -> {some}))"


def header(text: Column) -> Column:
    """The comment that a text begins with, or else its first paragraph."""
    body = F.regexp_replace(F.regexp_replace(text, r"^#![^\n]*(\n|$)", ""), r"^\s+", "")
    lines = F.split(body, "\n")
    code = F.array_position(F.transform(lines, lambda x: ~x.rlike(COMMENT)), True)
    run = F.array_join(F.when(code == 0, lines).otherwise(F.slice(lines, F.lit(1), F.greatest(code - 1, F.lit(0)).cast("int"))), "\n")
    out = F.when(body.startswith("/*"), F.substring_index(body, "*/", 1)).when(body.startswith("<!--"), F.substring_index(body, "-->", 1))
    for quote in ('"""', "'''"):
        out = out.when(body.startswith(quote), F.substring_index(body, quote, 2))
    return out.when(body.rlike(COMMENT), run).otherwise(F.split(body, r"\n[ \t\r]*\n", 2)[0])


def own_licences(files: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(id, tid, licence, score) of the files (file, path, text) with a part that matches a template."""
    spark = files.sparkSession
    full = full_texts()
    families = [(0, templates), (1, NOTICES | TITLES | full)]
    rows, idfs, others, found = [], [], [], {}
    for number, texts in families:
        weighed, idf, other = weights(texts, COMMON if number else set())
        every = {k: [[w] for w, _, t, _ in weighed if t == k] for k in texts if number and k in TITLES}
        need = {k: len(x) for k, x in every.items()}
        rows += [(number, w, k, k.split(" ")[0] if number else k, k in full if number else False, need.get(k, 0), share) for w, _, k, share in weighed]
        idfs += [(number, w, i) for w, i in sorted(idf.items())] + [(1, w, 0.0) for w in sorted(COMMON) if number]
        others.append((number, other))
        found |= anchors(weighed, threshold) | every
    terms = F.broadcast(spark.createDataFrame(rows, "family int, term string, template string, licence string, whole boolean, need int, share double"))  # as many rows as the templates have terms
    idf = F.broadcast(spark.createDataFrame(idfs, "family int, term string, idf double"))
    other = F.broadcast(spark.createDataFrame(others, "family int, other double"))

    part = lambda kind, at, want, held: f"named_struct('kind', '{kind}', 'at', int({at}), 'want', '{want}', 'words', {held})"
    passing = lambda kind, bodies: f"transform(filter(transform({bodies}, (x, i) -> struct(i AS at, x AS body)), x -> {may_match('x.body', found)}), x -> {part(kind, 'x.at', '', words_of('x.body'))})"
    shares = {k: {w: share * share for _, w, t, _, _, _, share in rows if t == k} for k in templates | NOTICES}
    near = [_windows(len(words(notice)), found[k], shares[k], threshold, lambda at, held, k=k: part("window", at, k, held)) for k, notice in sorted((templates | NOTICES).items())]
    windows = f"flatten(transform(array({words_of('text')}), held -> concat({', '.join(near)})))"
    texts = files.where(may_match("text", found)).select(*row_ids(), "text", F.array(header(F.col("text")), F.when(is_licence_file(F.col("path")), F.col("text"))).alias("bodies"))
    lines, blocks = passing("line", r"split(text, '\n')"), passing("block", "bodies")
    parts = texts.selectExpr("id", "tid", f"explode(concat({lines}, {blocks}, {windows})) AS part")

    by = ["id", "tid", "kind", "at", "want"]
    tokens = parts.select("id", "tid", "part.kind", "part.at", "part.want", F.explode("part.words").alias("term"))
    tf = materialize(tokens.groupBy(*by, "term").agg(F.count("*").alias("tf")), "terms")  # of parts with an anchor
    weighed = tf.crossJoin(other).join(idf, ["family", "term"], "left").withColumn("w", F.col("tf") * F.coalesce("idf", "other")).drop("idf", "other")
    norms = weighed.groupBy(*by, "family").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    asked = (F.col("want") == "") | (F.col("want") == F.col("template"))
    dots = weighed.join(terms, ["family", "term"]).where(asked).groupBy(*by, "family", "template", "licence", "whole", "need").agg(F.sum(F.col("w") * F.col("share")).alias("dot"), F.count("*").alias("shared")).where("shared >= need")
    scored = dots.join(norms, [*by, "family"]).select("id", "tid", "licence", "whole", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= threshold)
    best = F.max_by(F.struct("licence", "score"), F.struct("whole", "score", _descending(F.col("licence"), licences(templates))))
    return scored.groupBy("id", "tid").agg(best.alias("best")).select("id", "tid", "best.licence", "best.score")


def row_ids() -> tuple[Column, Column]:
    """What tells rows apart: hashes of id, path and text; rows that are equal in all are equal files."""
    known = [F.col(c) for c in ("file", "path", "text")]
    empty = [F.col(c).isNull() for c in ("file", "path", "text")]
    return F.xxhash64(*known, *empty).alias("id"), F.hash(*empty, *known).alias("tid")


def _windows(size: int, groups: list[list[str]], shares: dict[str, float], threshold: float, part) -> str:
    """The windows of ``size`` words of ``held`` that can match a notice: with a word of each group, and
    enough of its shares."""
    some = f"split('{' '.join(groups[0])}', ' ')"
    hits = f"filter(transform(held, (w, i) -> if(array_contains({some}, w), i + 1, NULL)), i -> i IS NOT NULL)"
    starts = f"array_distinct(flatten(transform({hits}, i -> sequence(greatest(i - {size - 1}, 1), i))))"
    weight = "map(" + ", ".join(f"'{w}', {float(x)!r}D" for w, x in shares.items()) + ")"
    worth = f"aggregate(array_distinct(slice(held, at, {size})), 0.0D, (total, w) -> total + coalesce({weight}[w], 0.0D))"
    near = f"filter({starts}, at -> {worth} >= {threshold**2 - 1e-4!r}D)"
    return f"transform(if({every_group('held', groups)}, {near}, cast(array() AS array<int>)), at -> {part('at', f'slice(held, at, {size})')})"


def licences(templates: dict[str, str]) -> list[str]:
    return sorted({*templates, *FULL, *(k.split(" ")[0] for k in NOTICES | TITLES)})


def _descending(licence: Column, order: list[str]) -> Column:
    """Greater for smaller names, so that a maximum picks the smaller."""
    return -F.array_position(F.array(*[F.lit(x) for x in order]), licence)


def scan(files: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """file, path, licence, score, found (own, inherited or none), from_dir of each row (file, path, text)."""
    own = own_licences(files.select("file", "path", "text"), templates, threshold)
    known = materialize(files.select("file", "path", parent(F.col("path")).alias("dir"), *row_ids()).join(own, ["id", "tid"], "left").drop("id", "tid"), "known")
    givers = known.where(is_licence_file(F.col("path")) & F.col("licence").isNotNull())
    best = F.max_by(F.struct("licence", "score"), F.struct("score", _descending(F.col("licence"), licences(templates))))
    giving = givers.groupBy("dir").agg(best.alias("best")).select(F.col("dir").alias("up"), "best.licence", "best.score")
    parts = F.split(F.col("dir"), "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    dirs = known.where("dir is not null").select("dir").distinct().select("dir", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), ups))).alias("up"))
    nearest = dirs.join(giving, "up").groupBy("dir").agg(F.max_by(F.struct("up", "licence", "score"), F.length("up")).alias("near"))
    out = known.join(nearest, "dir", "left")
    mine = F.col("licence").isNotNull()
    return out.select(
        "file",
        "path",
        F.coalesce("licence", "near.licence").alias("licence"),
        F.when(mine, F.col("score")).otherwise(F.col("near.score")).alias("score"),
        F.when(mine, "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("found"),
        F.when(~mine, F.col("near.up")).alias("from_dir"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files of a source tree: source/dN/, a licence file for each tenth document."""
    folder = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.concat(F.lit("d"), F.expr("doc_id div 200 % 16")), F.concat(F.lit("e"), F.expr("doc_id div 20 % 10")))
    top = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.concat(F.lit("d"), F.expr("doc_id div 200 % 16")))
    place = F.when(F.col("doc_id") % 20 == 0, F.concat(folder, F.lit("/LICENSE-"), F.col("doc_id"))).when(F.col("doc_id") % 200 == 7, F.concat(top, F.lit("/LICENSE-"), F.col("doc_id")))
    return docs.select(F.col("doc_id").alias("file"), place.alias("licence_path"), folder.alias("folder"), "text").select(
        "file", F.coalesce("licence_path", F.concat("folder", F.lit("/doc-"), F.col("file"), F.lit(".txt"))).alias("path"), "text"
    )


def scan_sql(templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The scan over ``document_paths(documents)`` in plain SQL."""
    rows, _, other = weights(templates)
    values = ", ".join(f"('{w}', {i!r}::DOUBLE, '{k}', {s!r}::DOUBLE)" for w, i, k, s in rows)
    return f"""
WITH t(term, idf, licence, share) AS (VALUES {values}),
     i AS (SELECT DISTINCT term, idf FROM t),
     d AS (SELECT doc_id AS file, text, coalesce(source, 'unknown') || '/d' || (doc_id // 200 % 16) AS top, coalesce(source, 'unknown') || '/d' || (doc_id // 200 % 16) || '/e' || (doc_id // 20 % 10) AS folder FROM documents),
     f AS (SELECT file, text, CASE WHEN file % 20 = 0 THEN folder || '/LICENSE-' || file WHEN file % 200 = 7 THEN top || '/LICENSE-' || file ELSE folder || '/doc-' || file || '.txt' END AS path FROM d),
     l AS (SELECT file, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM f),
     w AS (SELECT file, line, unnest(regexp_extract_all(lower(body), '{WORD}')) AS term FROM l WHERE regexp_matches(lower(body), '{MARKERS}')),
     tf AS (SELECT file, line, term, count(*) AS tf FROM w GROUP BY ALL),
     wt AS (SELECT file, line, tf.term, tf * coalesce(idf, {other!r}::DOUBLE) AS w FROM tf LEFT JOIN i ON tf.term = i.term),
     n AS (SELECT file, line, sqrt(sum(w * w)) AS norm FROM wt GROUP BY ALL),
     s AS (SELECT wt.file, wt.line, licence, sum(w * share) AS dot FROM wt JOIN t ON wt.term = t.term GROUP BY ALL),
     sc AS (SELECT s.file, licence, round(dot / norm, 6) AS score FROM s JOIN n ON s.file = n.file AND s.line = n.line),
     own AS (SELECT file, licence, score FROM sc WHERE score >= {threshold} QUALIFY row_number() OVER (PARTITION BY file ORDER BY score DESC, licence) = 1),
     k AS (SELECT f.file, path, regexp_replace(path, '/[^/]*$', '') AS dir, licence, score FROM f LEFT JOIN own ON f.file = own.file),
     g AS (SELECT dir AS up, licence, score FROM k WHERE licence IS NOT NULL AND path LIKE '%/LICENSE-%' QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, licence) = 1),
     ds AS (SELECT DISTINCT dir FROM k),
     nr AS (SELECT dir, up, licence, score FROM ds JOIN g ON dir = up OR starts_with(dir, up || '/') QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(up) DESC) = 1)
SELECT k.file AS doc_id, path, coalesce(k.licence, nr.licence) AS licence, CASE WHEN k.licence IS NOT NULL THEN k.score ELSE nr.score END AS score,
       CASE WHEN k.licence IS NOT NULL THEN 'own' WHEN nr.dir IS NOT NULL THEN 'inherited' ELSE 'none' END AS found, CASE WHEN k.licence IS NULL THEN nr.up END AS from_dir
FROM k LEFT JOIN nr ON k.dir = nr.dir
"""


def scan_documents(docs: DataFrame) -> DataFrame:
    return scan(document_paths(docs)).withColumnRenamed("file", "doc_id")


def session_needs_no_python(spark: SparkSession) -> bool:
    """For tests: the scan has no Python in its plan."""
    plan = scan(spark.createDataFrame([], "file long, path string, text string"))._jdf.queryExecution().toString()
    return "Python" not in plan and "Arrow" not in plan
