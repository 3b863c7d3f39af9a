"""Licence scans: sparse TF-IDF cosine of parts of texts to licence templates, then inheritance from directories.

Every word's inverse document frequency is counted over all texts. The parts of a text are its lines, every run of as
many words as a statement template has (across line ends, at each word), and the whole text; the first two are compared
with the statements, the whole also with full licence texts. A part's squared cosine to a template is at most the
squared weight of the template's words in it (Cauchy and Schwarz). So only texts with one of a template's rarest words, and
with enough of a template's weight in all, are looked at, and of these only the lines, the stretches of a statement's length and the whole texts that hold enough of
a template's weight; the idf of all other words is joined to those alone. Runs are pruned once more by sliding sums (repeated
words only make a norm larger); what passes is scored exactly, so nothing is lost. A file's licence is the full text that it is, or else
its best statement; a file without one inherits from the nearest ancestor directory that holds a licence file, by joins on
directory paths. Only DataFrame functions are used.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from skewmatch.llm.common import hot_join, written

# fixed values: licence statements by SPDX identifier
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "BSD-2-Clause": ["SPDX-License-Identifier: BSD-2-Clause", "Licensed under the BSD 2-Clause License."],
    "BSD-3-Clause": ["SPDX-License-Identifier: BSD-3-Clause", "Licensed under the BSD 3-Clause License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only",
                "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["The MIT License (MIT)", "Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
#: Full licence texts by SPDX identifier.
FULL = {p.stem: [p.read_text(encoding="utf-8")] for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice)([.-][^/]*)?$"
_BREAK = "[^a-z0-9]+"


def words(text: str) -> list[str]:
    return [w for w in re.split(_BREAK, text.lower()) if w]


def weights(templates: dict, idf: dict[str, float]) -> list[tuple[str, dict[str, float]]]:
    """One unit vector of TF-IDF weights per template statement."""
    out = []
    for name in sorted(templates):
        for text in templates[name]:
            raw = {t: n * idf[t] for t, n in Counter(words(text)).items()}
            norm = math.sqrt(sum(x * x for x in raw.values()))
            out.append((name, {t: x / norm for t, x in raw.items()}))
    return out


def leading(vectors: list[tuple[str, dict[str, float]]], threshold: float, idf: dict[str, float] | None = None) -> list[str]:
    """Words such that a part without any of them has a cosine below ``threshold`` to every template: of each template
    those with the largest weights, or with ``idf`` the rarest ones."""
    out = set()
    for _, vector in vectors:
        rest = 1.0
        for term, weight in sorted(vector.items(), key=lambda x: (-(idf[x[0]] if idf else x[1]), x[0])):
            if rest < threshold * threshold - 1e-9:
                break
            out.add(term)
            rest -= weight * weight
    return sorted(out)


def has_any(text: Column, terms: list[str]) -> Column:
    return F.lower(text).rlike("(?<![a-z0-9])(?:" + "|".join(terms) + ")(?![a-z0-9])")


def has_weight(text: Column, vectors: list[tuple[str, dict[str, float]]], threshold: float) -> Column:
    """Whether the words of ``text`` hold enough of one template's squared weight for some part to reach ``threshold``."""
    terms = sorted({t for _, v in vectors for t in v})
    squares = F.from_json(F.lit(json.dumps({t: [v.get(t, 0.0) ** 2 for _, v in vectors] for t in terms})), "map<string,array<double>>")
    held = F.aggregate(F.array_intersect(line_words(text), F.array(*map(F.lit, terms))), F.array_repeat(F.lit(0.0), len(vectors)),
                       lambda sums, t: F.zip_with(sums, F.element_at(squares, t), lambda x, y: x + y))
    return F.exists(held, lambda x: x >= threshold * threshold - 1e-9)


def line_words(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), _BREAK), lambda w: w != "")


def known_words(files: DataFrame, vectors, idf: dict[str, float]) -> DataFrame:
    """``(file, pos, line_no, place, many, term, weights, idf)`` of the words in ``files`` that some template has, with their weight
    in every template; ``place`` is that in the line, ``many`` the line's number of words."""
    terms = sorted({t for *_, v in vectors for t in v})
    table = files.sparkSession.createDataFrame([(t, [float(v.get(t, 0.0)) for *_, v in vectors], idf[t]) for t in terms],
                                               "term string, weights array<double>, idf double")
    return files.select("file", F.posexplode("at").alias("pos", "x")).select("file", "pos", "x.*").join(F.broadcast(table), "term")


def stretches(files: DataFrame, vectors, idf: dict[str, float], other: float, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Where a part may reach the threshold: ``(texts, lines, stretches)`` with ``file``, ``file, line_no`` and ``file, low, high``
    (disjoint; they cover the texts, the lines and all runs).

    A part's squared cosine is at most the squared weight of the template's words in it. For a whole text its norm is bounded too: words
    outside the templates have at least the idf ``other``."""
    least = threshold * threshold - 1e-9
    known = written(known_words(files, vectors, idf))
    brief = [(k, n) for k, (_, full, n, _) in enumerate(vectors) if not full]

    def covered(k):
        return F.sum(F.col("weights")[k] * F.col("weights")[k])

    def some(tests):
        return F.exists(F.array(*tests), lambda x: x)

    once = known.groupBy("file", "term").agg(F.first("weights").alias("weights"), F.first("idf").alias("idf"), F.count(F.lit(1)).alias("n"))
    value = F.col("n") * F.col("idf")
    whole = once.groupBy("file").agg(F.sum("n").alias("n"), F.sum(value * value).alias("norm"), *[
        F.when(covered(k) >= least, F.sum(value * F.col("weights")[k])).alias(f"dot{k}") for k in range(len(vectors))])
    norm = F.col("norm") + (F.col("size") - F.col("n")) * other * other
    dot = F.array_max(F.array(*[f"dot{k}" for k in range(len(vectors))]))
    texts = written(whole.join(files.select("file", F.size("at").alias("size")), "file")
                    .filter(dot >= (threshold - 1e-9) * F.sqrt(norm)).select("file", "size"))
    lines = written(known.groupBy("file", "line_no", "term").agg(F.first("weights").alias("weights"), F.min(F.col("pos") - F.col("place")).alias("low"),
                                                                 F.first("many").alias("many"))
                    .groupBy("file", "line_no", "low", "many").agg(some([covered(k) >= least for k, _ in brief]).alias("may"))
                    .filter("may").select("file", "line_no", "low", (F.col("low") + F.col("many") - 1).alias("high")))
    ordered = Window.partitionBy("file").orderBy("pos")
    marks = (known.select("file", "pos", F.array_max(F.array(*[
        F.when(covered(k).over(ordered.rangeBetween(0, n - 1)) >= least, F.lit(n)).otherwise(F.lit(0)) for k, n in brief])).alias("n"))
        .filter("n > 0").select("file", F.greatest(F.lit(0), F.col("pos") - F.col("n") + 1).alias("low"), (F.col("pos") + F.col("n") - 1).alias("high")))
    spans = marks.unionByName(lines.select("file", "low", "high")).unionByName(
        texts.select("file", F.lit(0).alias("low"), (F.col("size") - 1).alias("high")))
    by_low = Window.partitionBy("file").orderBy("low", "high")
    before = F.max("high").over(by_low.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("low") <= before, F.lit(0)).otherwise(F.lit(1))
    merged = (spans.withColumn("opens", opens).withColumn("island", F.sum("opens").over(by_low.rowsBetween(Window.unboundedPreceding, 0)))
              .groupBy("file", "island").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("island"))
    return texts.select("file"), lines.select("file", "line_no"), merged


def runs(valued: DataFrame, vectors, threshold: float) -> DataFrame:
    """``(file, start, words)`` of the runs of words that may reach the threshold, each as long as a statement.

    ``valued``: ``file, low, pos, term, idf`` per word. The dot product and a lower bound of the squared norm are sliding sums. A run that
    the end of a stretch cuts short has too little of a statement's squared weight (else the stretch would go on) and fails when scored."""
    brief = [(k, n) for k, (_, full, n, _) in enumerate(vectors) if not full]
    terms = sorted({t for _, full, _, v in vectors if not full for t in v})
    table = valued.sparkSession.createDataFrame([(t, [float(vectors[k][3].get(t, 0.0)) for k, _ in brief]) for t in terms],
                                                "term string, weights array<double>")
    ordered = Window.partitionBy("file", "low").orderBy("pos")
    tests = []
    for j, (_, n) in enumerate(brief):
        frame = ordered.rowsBetween(0, n - 1)
        dot = F.sum(F.coalesce(F.col("weights")[j], F.lit(0.0)) * F.col("idf")).over(frame)
        norm = F.sum(F.col("idf") * F.col("idf")).over(frame)
        tests.append(F.when(dot >= (threshold - 1e-9) * F.sqrt(norm), F.lit(n)))
    return (valued.join(F.broadcast(table), "term", "left").select("file", F.col("pos").alias("start"), F.array(*tests).alias("tests"))
            .select("file", "start", F.explode(F.array_distinct(F.filter("tests", lambda x: x.isNotNull()))).alias("words")))


def statements(valued: DataFrame, texts: DataFrame, lines: DataFrame, vectors, threshold: float) -> DataFrame:
    """``(file, full, start, stop, line_no, license, cosine)`` of the parts that reach the threshold, from ``valued``: ``file,
    low, pos, line_no, term, idf`` per word of the stretches; ``texts`` and ``lines`` are the parts of these kinds to score."""
    table = valued.sparkSession.createDataFrame(
        [(k, name, full, t, float(x)) for k, (name, full, _, v) in enumerate(vectors) for t, x in v.items()],
        "template int, license string, full boolean, term string, weight double")
    found = written(runs(valued, vectors, threshold))
    reach = found.select("file", "start", "words", F.explode(F.sequence("start", F.col("start") + F.col("words") - 1)).alias("pos"))
    word = ["pos", "line_no", "term", "idf"]

    def kind(number, start, count):
        return "file", F.lit(number).alias("kind"), F.struct(start.alias("start"), count.alias("words")).alias("part"), *word

    parts = (reach.join(valued, ["file", "pos"]).select(*kind(2, F.col("start"), F.col("words")))
             .unionByName(valued.join(lines, ["file", "line_no"], "left_semi").select(*kind(1, F.col("line_no"), F.lit(0))))
             .unionByName(valued.join(texts, "file", "left_semi").select(*kind(0, F.lit(0), F.lit(0)))))
    part = ["file", "kind", "part"]
    counted = parts.groupBy(*part, "term").agg((F.count(F.lit(1)) * F.first("idf")).alias("value"), F.min("pos").alias("first"),
                                               F.max("pos").alias("last"), F.min("line_no").alias("line_no"))
    known = table.groupBy("term").agg(F.collect_list(F.struct("template", "license", "full", "weight")).alias("uses"))
    norms = counted.join(F.broadcast(known), "term", "left").groupBy(*part).agg(
        F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"), F.min("first").alias("start"), (F.max("last") + 1).alias("stop"),
        F.min("line_no").alias("line_no"), F.collect_list(F.when(F.col("uses").isNotNull(), F.struct("value", "uses"))).alias("known"))
    dots = (norms.select(*part, "norm", "start", "stop", "line_no", F.explode("known").alias("k"))
            .select(*part, "norm", "start", "stop", "line_no", "k.value", F.explode("k.uses").alias("use")).filter("kind = 0 or not use.full")
            .groupBy(*part, "start", "stop", "line_no", "use.template", "use.license", "use.full")
            .agg((F.sum(F.col("value") * F.col("use.weight")) / F.first("norm")).alias("cosine")))
    return dots.filter(F.col("cosine") >= threshold).select("file", "full", "start", "stop", "line_no", "license", F.round("cosine", 9).alias("cosine"))


def parent(path: Column) -> Column:
    """The directory of a path; the empty string is the root."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), F.lit(""))


def inherit(files: DataFrame) -> DataFrame:
    """``files`` (``file, directory, license, stands``) with ``inherited`` and ``inherited_from``: the licence of the nearest
    directory, its own or one above, that holds a standing licence file (the one with the smallest path)."""
    given = written(files.filter("stands and license is not null and directory is not null").groupBy("directory")
                    .agg(F.min(F.struct("path", "license")).alias("head")).select("directory", F.col("head.license").alias("given")))
    wanted = files.filter("license is null and directory is not null").groupBy("directory").agg(F.count(F.lit(1)).alias("rows"))
    parts = F.split("own", "/")
    depth = F.when(F.col("own") == "", F.lit(0)).otherwise(F.size(parts))
    chain = written(wanted.withColumnRenamed("directory", "own").select("own", "rows", F.explode(F.sequence(F.lit(0), depth)).alias("depth"))
                    .withColumn("directory", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/")))
    near = (hot_join(chain, given, ["directory"], "inner").groupBy("own", "rows")
            .agg(F.max(F.struct("depth", "given", "directory")).alias("near"))
            .select(F.col("own").alias("directory"), "rows", F.col("near.given").alias("inherited"), F.col("near.directory").alias("inherited_from")))
    joined = hot_join(files, written(near), ["directory"], "left", rows_col="rows").drop("rows")
    return joined.select(*files.columns, *(F.when(F.col("license").isNull(), F.col(c)).alias(c) for c in ("inherited", "inherited_from")))


def scan_licenses(docs: DataFrame, path: Column, stands: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
                  templates: dict | None = None, threshold: float = 0.8) -> DataFrame:
    """``doc_id, path, license, cosine, n_statements, inherited, inherited_from, effective`` per input row.

    ``path`` is an expression over ``docs``; ``stands`` one over ``doc_id``, ``path`` and ``first_line`` (line number of the
    first statement) that says which files with a licence license their directory (by default: named like a licence file). A null or empty text
    has no statement, a null path no directory; ties go to the licence that sorts first; repeated rows
    are files of their own; an empty table gives no rows; other columns are ignored. ``n_statements`` counts stretches of overlapping
    finds. A text of any length is scanned whole, its words as one array in a task. The template words' document counts
    (a fixed number of rows) and the largest count of any other word reach the driver.
    """
    full = FULL if templates is None else {}
    templates = TEMPLATES if templates is None else templates
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), path.cast("string").alias("path"), text.alias("text"))
    total = plain.count()
    counts = written(plain.select(F.explode(F.array_distinct(line_words(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    vocabulary = sorted({w for group in (templates, full) for texts in group.values() for t in texts for w in words(t)})
    ours = F.broadcast(plain.sparkSession.createDataFrame([(t,) for t in vocabulary], "term string"))
    seen = dict(counts.join(ours, "term").select("term", "n").collect())
    idf = {t: math.log((1 + total) / (1 + seen.get(t, 0))) + 1 for t in vocabulary}
    often = counts.join(ours, "term", "left_anti").agg(F.max("n")).first()[0] or 0
    other = math.log((1 + total) / (1 + often)) + 1
    vectors = [(name, group is full, len(words(t)), v) for group in (templates, full)
               for (name, v), t in zip(weights(group, idf), (t for name in sorted(group) for t in group[name]))]
    leads, rare = ([t for t in leading([(name, v) for name, whole, _, v in vectors if whole == kind], threshold, idf) if t in seen]
                   for kind in (False, True))
    brief = [(name, v) for name, whole, _, v in vectors if not whole]
    wanted = F.when(has_any(F.col("text"), leads), has_weight(F.col("text"), brief, threshold)).otherwise(F.lit(False)) if leads else F.lit(False)
    if rare:
        wanted = wanted | F.arrays_overlap(line_words(F.col("text")), F.array(*map(F.lit, rare)))
    files = written(plain.select("doc_id", "path", F.when(wanted, F.col("text")).alias("text"))
                    .withColumn("file", F.monotonically_increasing_id()))
    at = F.flatten(F.transform(F.transform(F.split("text", "\n"), line_words), lambda ws, k: F.transform(
        ws, lambda w, j: F.struct(k.alias("line_no"), j.alias("place"), F.size(ws).alias("many"), w.alias("term")))))
    held = files.filter("text is not null").select("file", at.alias("at"))
    texts, lines, spans = stretches(held, vectors, idf, other, threshold)
    listed = written(spans.groupBy("file").agg(F.collect_list(F.struct("low", "high")).alias("spans")))
    cut = F.flatten(F.transform("spans", lambda s: F.transform(
        F.slice("at", s["low"] + 1, s["high"] - s["low"] + 1), lambda x, j: F.struct(
            s["low"].alias("low"), (s["low"] + j).alias("pos"), x["line_no"].alias("line_no"), x["term"].alias("term")))))
    tokens = written(held.join(listed, "file").select("file", F.explode(cut).alias("x")).select("file", "x.*"))
    measured = counts.select("term", (F.log((1 + total) / (1 + F.col("n"))) + 1).alias("idf"))
    valued = written(hot_join(tokens, measured, ["term"]))
    found = written(statements(valued, texts, lines, vectors, threshold))
    before = F.max("stop").over(Window.partitionBy("file").orderBy("start", "stop", "license", "full", "cosine").rowsBetween(Window.unboundedPreceding, -1))
    own = found.withColumn("opens", F.coalesce((F.col("start") >= before).cast("int"), F.lit(1))).groupBy("file").agg(
        F.min(F.struct((~F.col("full")).alias("part"), (-F.col("cosine")).alias("down"), "start", "license")).alias("best"),
        F.sum("opens").alias("n_statements"), F.min("line_no").alias("first_line"))
    rule = F.coalesce(F.col("path").rlike(LICENCE_FILE) if stands is None else stands, F.lit(False))
    marked = written(files.drop("text").join(own, "file", "left").select(
        "file", "doc_id", "path", parent(F.col("path")).alias("directory"), F.col("best.license").alias("license"),
        (-F.col("best.down")).alias("cosine"), F.coalesce("n_statements", F.lit(0)).cast("long").alias("n_statements"),
        rule.alias("stands")))
    return inherit(marked).select("doc_id", "path", "license", "cosine", "n_statements", "inherited", "inherited_from",
                                  F.coalesce("license", "inherited").alias("effective"))
