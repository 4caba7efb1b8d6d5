"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Every line of a file, and from every line on the runs of lines that reach each
length of RUNS words, is a vector of its words' counts times their inverse
document frequencies, which are counted over all files; words outside the
templates weigh as the rarest. So a notice is compared as a whole however its
lines are wrapped and however long the rest of the file is. A file
declares the template of its best cosine, if that reaches THRESHOLD. A declaring
file is its directory's licence file if it is called so (LICENSE, COPYING, ...)
or if the declaration makes up most of its words. A file that declares nothing
inherits from the nearest of its ancestor directories that has a licence file.

Results in odd cases: null or empty texts declare nothing but may inherit; a
null path has no directories, and neither inherits nor gives a licence; paths
are split at ``/``, empty parts left out. Equal cosines go to the template
listed first, and of a directory's licence files the best cosine, then the
smallest path. Every row gives one row. Columns besides ``path``, ``text`` and
those kept are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm._text import IS_LETTER, LOWER, Lookup, Spans, cut, expand, look, read, segment_sum, text_blocks

THRESHOLD, MOSTLY = 0.6, 0.5
_UNIT_WORDS = 1 << 18
#: Directories with a licence that are broadcast at most; more are joined in so many shares each.
FEW_DIRS, SALTS = 50_000, 16
# Short forms of the notices by which files state well-known licences.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Runs of lines end with the line by which they have so many words: each template's length, and some more.
RUNS = sorted({len(re.findall(r"[A-Za-z0-9]+", t)) + more for _, t in TEMPLATES for more in (0, 6)})
LICENCE_FILES = "(?i)(^|/)(licen[cs]e|copying|copyright|notice)([.-][^/]*)?$"

_INSIDE = IS_LETTER.copy()
_INSIDE[48:58] = True


def _words(buf: np.ndarray, offs: np.ndarray) -> Spans:
    return Spans(look(LOWER, buf), look(_INSIDE, buf), offs)


@dataclass
class Matcher:
    """Templates as unit vectors over their vocabulary."""

    names: list[str]
    vocabulary: Lookup
    idf: np.ndarray
    other: float  # idf of words outside the vocabulary
    weights: np.ndarray  # terms x templates

    def unit_scores(self, term: np.ndarray, owner: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Cosines, units x templates: term (-1 outside) and unit of each word; words of each unit."""
        units, n = len(length), len(self.idf)
        known = term >= 0
        key, tf = np.unique(owner[known] * n + term[known], return_counts=True)
        u, t = key // n, key % n
        value = tf * self.idf[t]
        square = np.bincount(u, value**2, units) + (length - np.bincount(owner[known], minlength=units)) * self.other**2
        first = np.searchsorted(u, np.arange(units + 1))
        dot = segment_sum(value[:, None] * self.weights[t], first)
        return dot / np.sqrt(np.maximum(square, 1e-12))[:, None]


def vocabulary() -> tuple[Lookup, list[np.ndarray]]:
    """Numbers of the templates' words, and each template's word numbers."""
    column = pa.array([t for _, t in TEMPLATES], pa.large_string())
    (_, _, buf, offs), = text_blocks(column)
    w = _words(buf, offs)
    h = w.hashes()
    keys = np.unique(h)
    number = np.searchsorted(keys, h)
    return Lookup(keys, np.arange(len(keys))), [number[w.first[k] : w.first[k + 1]] for k in range(len(TEMPLATES))]


def fit(files: DataFrame) -> Matcher:
    """Document frequencies of the templates' words over all files."""
    lookup, templates = vocabulary()
    n = len(lookup.keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n + 1, np.int64)
        for batch in batches:
            total[n] += batch.num_rows
            for _, _, buf, offs in text_blocks(batch.column(0)):
                w = _words(buf, offs)
                at, number = lookup.find(w.hashes())
                pairs = np.unique(w.owner()[at] * n + number)
                total[:n] += np.bincount(pairs % n, minlength=n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n + 1)), pa.array(total)], ["term", "n"])

    rows = files.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(n + 1)
    df[rows["term"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    idf = np.log((df[n] + 1) / (df[:n] + 1)) + 1
    weights = np.zeros((n, len(TEMPLATES)))
    for k, own in enumerate(templates):
        np.add.at(weights[:, k], own, idf[own])
    weights /= np.sqrt((weights**2).sum(axis=0))
    return Matcher([x for x, _ in TEMPLATES], lookup, idf, float(np.log(df[n] + 1) + 1), weights)


def _runs(begin: np.ndarray, end: np.ndarray, first: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end word, first line) of every line, and of every line's runs that reach the lengths in RUNS."""
    n = len(begin)
    last = end[first[owner + 1] - 1] if n else end  # where the line's document ends
    starts, ends, at = [begin], [end], [np.arange(n)]
    for length in RUNS:
        stop = np.minimum(begin + length, last)
        to = end[np.minimum(np.searchsorted(end, stop), n - 1)] if n else end
        grown = np.flatnonzero(to > end)  # a length reached by fewer lines gives the same run; it counts once
        starts.append(begin[grown])
        ends.append(to[grown])
        at.append(grown)
    begin, end, at = (np.concatenate(x) for x in (starts, ends, at))
    order = np.lexsort((end, at))
    begin, end, at = begin[order], end[order], at[order]
    once = np.ones(len(at), bool)
    once[1:] = (at[1:] != at[:-1]) | (end[1:] != end[:-1])
    once &= end > begin
    return begin[once], end[once], at[once]


def _promising(m: Matcher, term: np.ndarray, begin: np.ndarray, end: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The units whose known words could bring a cosine to THRESHOLD."""
    known = term >= 0
    weight = np.concatenate(([0.0], np.cumsum(np.where(known, m.idf[np.maximum(term, 0)], 0.0))))
    others = np.concatenate(([0], np.cumsum(~known)))
    mass = weight[end] - weight[begin]  # at least the length of the unit's known part
    foreign = (others[end] - others[begin]) * m.other**2
    good = (mass > 0) & (foreign * THRESHOLD**2 <= (1 - THRESHOLD**2) * mass**2 + 1e-9)
    return begin[good], end[good], line[good]


def _best(column: pa.Array, m: Matcher) -> list[tuple[str | None, float, float]]:
    """(licence, cosine, share of the file's words that declare it) of each text."""
    out: list[tuple[str | None, float, float]] = []
    for _, _, buf, offs in text_blocks(column):
        docs = len(offs) - 1
        w, lines = _words(buf, offs), Spans(buf, buf != 10, offs)
        at, number = m.vocabulary.find(w.hashes())
        term = np.full(len(w), -1)
        term[at] = number
        owner, held = lines.owner(), np.searchsorted(w.starts, lines.starts)  # words before each line
        begin, end, unit_line = _runs(held, np.searchsorted(w.starts, lines.ends), lines.first, owner)
        begin, end, unit_line = _promising(m, term, begin, end, unit_line)
        best, top, share = np.full(docs, -1), np.zeros(docs), np.zeros(docs)
        turn = np.cumsum(end - begin) // _UNIT_WORDS
        for t in np.unique(turn):
            own = np.flatnonzero(turn == t)
            n = end[own] - begin[own]
            score = m.unit_scores(term[expand(begin[own], n)], np.repeat(np.arange(len(own)), n), n)
            peak, which = score.max(axis=1).round(12), score.argmax(axis=1)
            d = owner[unit_line[own]]
            order = np.lexsort((n, unit_line[own], -peak, d))
            for x in order[np.unique(d[order], return_index=True)[1]]:
                if peak[x] > top[d[x]]:
                    best[d[x]], top[d[x]], share[d[x]] = which[x], peak[x], n[x] / max(1, w.counts[d[x]])
        out += [(m.names[b], float(min(1.0, s)), float(p)) if s >= THRESHOLD - 1e-9 else (None, float(s), 0.0) for b, s, p in zip(best, top, share, strict=True)]
    return out


def scan(files: DataFrame, matcher: Matcher, keep: list[str]) -> DataFrame:
    """The columns in keep (path among them), declared, cosine and share."""
    shared = files.sparkSession.sparkContext.broadcast(matcher)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _best(batch.column(batch.num_columns - 1), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.float64())], [*keep, "declared", "cosine", "share"])

    return files.select(*keep, F.col("text").alias("__t")).mapInArrow(run, files.select(*keep).schema.add("declared", "string").add("cosine", "double").add("share", "double"))


def inherit(scanned: DataFrame) -> DataFrame:
    """Adds license and license_from (``file``, a directory, or null) by path joins."""
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    rows = scanned.withColumn("__dir", F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/"))
    given = rows.filter(F.col("path").isNotNull() & F.col("declared").isNotNull() & (F.col("path").rlike(LICENCE_FILES) | (F.col("share") >= MOSTLY)))
    given = given.groupBy(F.col("__dir").alias("dir")).agg(F.min(F.struct((-F.col("cosine")).alias("c"), "path", "declared"))["declared"].alias("given"))
    # each directory looks up its ancestors once; files then join their own directory only
    dirs = rows.filter("path is not null").select("__dir").distinct()
    steps = F.filter(F.split("__dir", "/"), lambda x: x != "")
    chain = dirs.select("__dir", F.explode(F.sequence(F.lit(0), F.size(steps))).alias("depth")).withColumn("dir", F.array_join(F.slice(steps, 1, F.col("depth")), "/"))
    nearest = cut(chain.join(given, "dir").groupBy("__dir").agg(F.max(F.struct("depth", "dir", "given")).alias("near")), "nearest")
    if nearest.limit(FEW_DIRS + 1).count() <= FEW_DIRS:  # one directory may hold most files: those stay where they are
        out = rows.join(F.broadcast(nearest), "__dir", "left")
    else:  # dealt by directory and file, each directory's licence to all of its shares
        salted = nearest.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = rows.withColumn("__salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")).join(salted, ["__dir", "__salt"], "left")
    path_known = F.col("path").isNotNull()
    return out.select(*scanned.columns, F.coalesce("declared", F.when(path_known, F.col("near.given"))).alias("license"), F.when(F.col("declared").isNotNull(), "file").when(path_known, F.col("near.dir")).alias("license_from"))


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/id.txt``: the tables have no paths of their own."""
    docs = read(spark, sf_dir, "documents")
    files = docs.select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text")
    return inherit(cut(scan(files, fit(files), ["doc_id", "path"]), "scanned"))
