"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

Text and templates are lower-cased and reduced to runs of ASCII letters and digits. The units compared are
the lines of a text, its paragraphs (lines up to an empty one), the whole text and all windows of words in it, across lines too, so a
notice within a longer line or a comment block is found. Each is a set of word bigrams: Dice is twice the
common bigrams over the sum of both counts. It can't reach the threshold t unless the counts are within a factor
t / (2 - t) of each other, so templates outside those size bounds are pruned, and so are those of which a text has less than that factor of the bigrams. The best window
of a template starts and ends with bigrams of the template that it has but once, so only those are tried.
The best unit wins; equal ones go to the first line, then to the smaller unit (line, paragraph, text, window), then to the template first
in the alphabet. A line counts as a licence line if it or a window inside it reaches the threshold. ORACLE states the result of lines, paragraphs and whole
texts without windows: the same wherever each notice is a line of its own that equals a template.

Null or empty text has no line and no licence. Units of one word have no bigram and match nothing. Repeated rows give repeated rows, a null doc_id stays null, an empty table gives no rows; a very long text is
one row of one task, its windows are bounded by the templates' sizes. Columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm.common import arrow_map, table, texts_of, with_text

SCHEMA = "doc_id long, n_lines long, n_license_lines long, license string, dice double, line_no long"
THRESHOLD = 0.8
#: Licence notices and grants as they are published, by SPDX-like name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
WORDS = re.compile("[a-z0-9]+").findall


def bigrams(text: str) -> frozenset[tuple[str, str]]:
    words = WORDS(text.lower())
    return frozenset(zip(words, words[1:], strict=False))


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float):
        self.templates = sorted((name, bigrams(t)) for name, t in templates.items())
        self.threshold = threshold
        factor = threshold / (2 - threshold)
        sizes = [len(b) for _, b in self.templates if b]
        self.least, self.most = min(sizes, default=1) * factor, max(sizes, default=0) / factor
        self.factor = factor
        self.by_bigram: dict[tuple[str, str], list[int]] = {}
        for k, (_, b) in enumerate(self.templates):
            for x in b:
                self.by_bigram.setdefault(x, []).append(k)

    def best(self, text: str) -> tuple[float, str] | None:
        """The closest template of a unit, if any reaches the threshold."""
        own = bigrams(text)
        n = len(own)
        if not self.least <= n <= self.most:
            return None
        found = None
        for k in sorted({k for x in own for k in self.by_bigram.get(x, ())}):
            name, other = self.templates[k]
            if n * self.factor <= len(other) and len(other) * self.factor <= n:
                dice = 2.0 * len(own & other) / (n + len(other))
                if dice >= self.threshold and (found is None or dice > found[0]):
                    found = dice, name
        return found

    def window(self, grams: list[tuple[str, str]], k: int, start: int, end: int) -> tuple[float, int] | None:
        """Dice and start of the window of grams[start:end] closest to template k, the first of equal ones, if any reaches the threshold."""
        other = self.templates[k][1]
        most = len(other) / self.factor
        found = None
        for a in range(start, end):
            first = grams[a]
            if first not in other:
                continue
            seen: set[tuple[str, str]] = set()
            common = 0
            for b in range(a, end):
                x = grams[b]
                if x in seen:
                    if x == first:
                        break  # the window from there on has the same bigrams
                    continue
                seen.add(x)
                if len(seen) > most:
                    break
                if x in other:
                    common += 1
                    dice = 2.0 * common / (len(seen) + len(other))
                    if dice >= self.threshold and (found is None or dice > found[0]):
                        found = dice, a
        return found

    def able(self, grams: Iterable[tuple[str, str]]) -> list[int]:
        """Templates of which enough bigrams are there for some window to reach the threshold."""
        counts = Counter(k for x in set(grams) & self.by_bigram.keys() for k in self.by_bigram[x])
        return sorted(k for k, n in counts.items() if n >= len(self.templates[k][1]) * self.factor - 1e-9)

    def scan(self, text: str) -> tuple[int, int, str | None, float | None, int | None]:
        lines = text.split("\n") if text else []
        words = WORDS(text.lower())
        grams = list(zip(words, words[1:], strict=False))
        able = self.able(grams)
        if not able:
            return len(lines), 0, None, None, None
        ends = list(accumulate(len(WORDS(line.lower())) for line in lines))
        units, hits = [], 0
        for k, line in enumerate(lines):
            m = self.best(line)
            if m:
                units.append((-m[0], k, 0, m[1]))
            start, end = (ends[k - 1] if k else 0), ends[k] - 1
            hits += bool(m) or any(self.window(grams, t, start, end) for t in self.able(grams[start:end]))
        start = 0
        for k in range(len(lines) + 1):
            if k == len(lines) or not lines[k].strip(" \t\v\f\r"):
                if k - start > 1 and (m := self.best(" ".join(lines[start:k]))):
                    units.append((-m[0], start, 1, m[1]))
                start = k + 1
        if len(lines) > 1 and (m := self.best(text)):
            units.append((-m[0], 0, 2, m[1]))
        for t in able:
            if m := self.window(grams, t, 0, len(grams)):
                units.append((-m[0], bisect_right(ends, m[1]), 3, self.templates[t][0]))
        if not units:
            return len(lines), 0, None, None, None
        dice, k, _, name = min(units)
        return len(lines), hits, name, -dice, k + 1


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_lines, n_license_lines, license, dice, line_no) of each document."""
    given = dict(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner(given, threshold)
        for batch in batches:
            rows = [s.scan(t) for t in texts_of(batch.column("text"))]
            cols = zip(*rows, strict=True) if rows else ((),) * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_lines", "n_license_lines", "license", "dice", "line_no"])

    return arrow_map(with_text(docs), run, SCHEMA)


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_GRAMS = "list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
_NORMAL = "list_filter(string_split(regexp_replace(lower({t}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"
ORACLE = f"""
WITH templates AS (SELECT name, {_GRAMS.format(w="w")} AS g FROM (SELECT name, {_NORMAL.format(t="body")} AS w FROM (VALUES {", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in sorted(TEMPLATES.items()))}) v(name, body))),
docs AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(text, chr(10)) END AS lines FROM documents),
each AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS k FROM docs),
breaks AS (SELECT *, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) = '' AS empty, sum(CASE WHEN trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS p FROM each),
units AS (
  SELECT doc_id, k, 0 AS kind, line AS body FROM each
  UNION ALL SELECT doc_id, min(k), 1, string_agg(line, ' ' ORDER BY k) FROM breaks WHERE NOT empty GROUP BY doc_id, p HAVING count(*) > 1
  UNION ALL SELECT doc_id, 1, 2, text FROM docs WHERE len(lines) > 1),
grams AS (SELECT doc_id, k, kind, {_GRAMS.format(w="w")} AS g FROM (SELECT doc_id, k, kind, {_NORMAL.format(t="body")} AS w FROM units) WHERE len(w) > 1),
scored AS (SELECT u.doc_id, u.k, u.kind, t.name, 2.0::DOUBLE * len(list_intersect(u.g, t.g)) / (len(u.g) + len(t.g)) AS dice FROM grams u JOIN templates t ON len(u.g) * {THRESHOLD / (2 - THRESHOLD)} <= len(t.g) AND len(t.g) * {THRESHOLD / (2 - THRESHOLD)} <= len(u.g)),
good AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, k, kind, name) AS r FROM scored WHERE dice >= {THRESHOLD}),
counted AS (SELECT doc_id, count(DISTINCT CASE WHEN kind = 0 THEN k END) AS n FROM good GROUP BY doc_id)
SELECT d.doc_id, len(d.lines)::BIGINT AS n_lines, coalesce(c.n, 0)::BIGINT AS n_license_lines, g.name AS license, g.dice, g.k::BIGINT AS line_no
FROM docs d LEFT JOIN counted c USING (doc_id) LEFT JOIN good g ON g.doc_id = d.doc_id AND g.r = 1
"""
