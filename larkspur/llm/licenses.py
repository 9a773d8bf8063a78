"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

A template's set are its distinct ``SHINGLE``-word shingles.  A text is read in
overlapping windows of shingles: for templates of m shingles the step s is a
quarter of m and the window the fewest steps that hold m shingles wherever they
start.  A template is in a text if one window holds at least ``PERCENT`` of
its set.  Such a window and the template have a Jaccard similarity of at least
j = hit / (window + m - hit); ``bands`` picks rows and bands so that a pair with
this similarity shares a band with a probability of at least 1 - ``MISS``.
Minima are taken once for each step and shared by the windows that hold it.
Every window that a band retrieves is verified on the whole sets.

A text that has fewer of the shingles of a size's templates, counted anywhere in
it, than a window needs can't hold one and isn't sketched for that size.

Templates are a parameter, a list that the caller holds, sent to every task.
Null texts and texts of fewer words than a shingle have no windows and no
licenses; texts may be of any length; repeated rows each get their result.
Templates that tie are all named, in order of their names.  Columns of any name
pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.decontam import word_hashes
from larkspur.llm.kernels import U64, gram_hashes, mix, ranges, text_chunks

SHINGLE, PERCENT, MISS = 5, 80, 1e-6

#: Notices as they are commonly written, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "MIT": "Released under the MIT License",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
}
#: Whole texts (-text) and the headers of source files (-notice) as their authors publish them.
TEMPLATES |= {f.stem: f.read_text("utf-8") for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def bands(similarity: float, miss: float = MISS) -> tuple[int, int]:
    """(rows, bands) with (1 - similarity^rows)^bands <= miss: as many rows as 96 minima allow."""
    if similarity >= 1:
        return 1, 1
    need = lambda rows: max(1, math.ceil(math.log(miss) / math.log1p(-(similarity**rows))))
    rows = 1
    while (rows + 1) * need(rows + 1) <= 96:
        rows += 1
    return rows, need(rows)


@dataclass
class Class:
    """Templates of one size: step and number of steps in a window, rows and bands, and the bands' contents."""

    step: int
    steps: int
    rows: int
    bands: int
    names: list[str]
    sets: list[np.ndarray]
    least: list[int]
    tables: list[np.ndarray]  #: sorted band values, one array per band

    @property
    def window(self) -> int:
        return self.step * self.steps


def minimum(h: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Minimum of the k-th hash function over each of the runs that begin at starts."""
    return np.minimum.reduceat((h ^ _XOR[k]) * _TIMES[k], starts)


_MOST = 8192  #: hash functions
_XOR, _TIMES = mix(np.arange(1, _MOST + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)), mix(np.arange(_MOST + 1, 2 * _MOST + 1, dtype=np.uint64)) | U64(1)


def band(h: np.ndarray, starts: np.ndarray, number: int, rows: int, text: np.ndarray, steps: int) -> np.ndarray:
    """Value of one band for each window: a window is the run that begins at a start and the next ``steps`` - 1 of its text."""
    out = np.full(len(starts), U64(number + 1))
    for k in range(number * rows, (number + 1) * rows):
        low = minimum(h, starts, k)
        wide = low.copy()
        for s in range(1, min(steps, len(low))):
            same = text[s:] == text[:-s]
            wide[:-s][same] = np.minimum(wide[:-s], low[s:])[same]
        out = mix(out ^ wide)
    return out


def classes(templates: dict[str, str], percent: int = PERCENT, miss: float = MISS) -> list[Class]:
    """The templates by size; those of fewer words than a shingle can't be found and are an error."""
    by: dict[tuple[int, int], list] = {}
    for name, text in templates.items():
        h, _ = word_hashes(pa.array([text]))
        own = np.unique(gram_hashes(h, SHINGLE))
        if not len(own):
            raise ValueError(f"template {name} has fewer than {SHINGLE} words")
        m = len(h) - SHINGLE + 1  # shingles with repeats: what a window must hold
        step = -(-m // 4)
        by.setdefault((step, -(-(m + step - 1) // step)), []).append((name, own))
    out = []
    for (step, steps), found in sorted(by.items()):
        least = [-(-percent * len(s) // 100) for _, s in found]
        j = min(k / (step * steps + len(s) - k) for (_, s), k in zip(found, least, strict=True))
        rows, count = bands(min(1.0, j), miss)
        if rows * count > _MOST:
            raise ValueError(f"{percent} per cent needs {rows * count} hash functions; there are {_MOST}")
        one = np.zeros(1, np.int64)
        tables = [np.unique(np.concatenate([band(s, one, b, rows, one, 1) for _, s in found])) for b in range(count)]
        out.append(Class(step, steps, rows, count, [n for n, _ in found], [s for _, s in found], least, tables))
    return out


def scan(h: np.ndarray, words: np.ndarray, kinds: list[Class]) -> Iterator[tuple[int, str, int, int, int]]:
    """(text, template, shingles found, of how many, first shingle of the window) for each window that holds a template."""
    grams = gram_hashes(h, SHINGLE)
    count = np.maximum(np.diff(words) - SHINGLE + 1, 0)
    if not count.any():
        return
    # The shingles inside texts, text after text.
    base = np.cumsum(count) - count
    own = np.repeat(words[:-1] - base, count) + np.arange(int(count.sum()))
    own = grams[own]
    # Shingles that may be a template's: looked up by their first bits, then exactly for each class.
    first = np.zeros(1 << 20, bool)
    for c in kinds:
        for full in c.sets:
            first[full >> U64(44)] = True
    near = np.flatnonzero(first[own >> U64(44)])
    text = np.searchsorted(base + count, near, "right")
    for c in kinds:
        hits = np.isin(own[near], np.concatenate(c.sets))
        some = np.flatnonzero(np.bincount(text[hits], minlength=len(count)) >= min(c.least))  # others can't hold enough
        if not len(some):
            continue
        yield from _in_class(c, own[ranges(base[some], count[some])] if len(some) < len(count) else own, count[some], some)


def _in_class(c: Class, own: np.ndarray, count: np.ndarray, number: np.ndarray) -> Iterator[tuple[int, str, int, int, int]]:
    """``scan`` for one class over texts of ``count`` shingles, ``own`` one after the other; ``number`` are the texts' own numbers."""
    base = np.cumsum(count) - count
    steps = -(-count // c.step)
    first = np.cumsum(steps) - steps
    text = np.repeat(np.arange(len(count)), steps)
    at = base[text] + (np.arange(len(text)) - first[text]) * c.step
    hit = np.zeros(len(text), bool)
    for b, table in enumerate(c.tables):
        v = band(own, at, b, c.rows, text, c.steps)
        spot = np.searchsorted(table, v)
        spot[spot == len(table)] = 0
        hit |= table[spot] == v
    for w in np.flatnonzero(hit).tolist():
        d = int(text[w])
        window = own[at[w] : min(at[w] + c.window, base[d] + count[d])]
        for name, full, least in zip(c.names, c.sets, c.least, strict=True):
            inside = np.isin(full, window)
            if (n := int(inside.sum())) >= least:
                yield int(number[d]), name, n, len(full), int(at[w] - base[d])


RESULT = "n_words long, n_licenses long, licenses string, containment double, first_window long"
_NAMES = [x.split()[0] for x in RESULT.split(", ")]


def find(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text", percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """Adds RESULT to every row: words, templates found (sorted, comma-joined; empty if none), the greatest
    containment and the first shingle of the first window with a license (null if none).  Columns of those names are replaced.
    """
    docs = docs.drop(*_NAMES)
    kinds = classes(TEMPLATES if templates is None else templates, percent, miss)
    schema = docs.select("*", *(F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in RESULT.split(", "))).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, text):
            h, w = word_hashes(batch.column(text))
            n = batch.num_rows
            names: list[set] = [set() for _ in range(n)]
            best, first = [None] * n, [None] * n
            for d, name, found, full, at in scan(h, w, kinds):
                names[d].add(name)
                best[d] = max(best[d] or 0.0, found / full)
                first[d] = at if first[d] is None else min(first[d], at)
            out = [pa.array(np.diff(w).astype(np.int64)), pa.array([len(x) for x in names], pa.int64()), pa.array([",".join(sorted(x)) for x in names], pa.string()), pa.array(best, pa.float64()), pa.array(first, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *_NAMES])

    return docs.mapInArrow(read, schema)


def sql(templates: dict[str, str] | None = None, percent: int = PERCENT) -> str:
    """DuckDB SQL of the whole scan over ``documents`` without any sketch."""
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in (templates or TEMPLATES).items())
    cut = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH t AS (SELECT name, {cut} AS w FROM (VALUES {rows}) AS v(name, text)),
tg AS (SELECT DISTINCT name, len(w) - {SHINGLE - 1} AS m, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM t)),
size AS (SELECT name, any_value(m) AS m, count(*) AS k, (any_value(m) + 3) // 4 AS step FROM tg GROUP BY name),
grid AS (SELECT name, k, step, step * ((m + step - 1 + step - 1) // step) AS win FROM size),
dw AS (SELECT doc_id, {cut} AS w FROM documents),
dg AS (SELECT doc_id, i - 1 AS p, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM dw WHERE len(w) >= {SHINGLE})),
hit AS (SELECT doc_id, p, s, name, k, step, win FROM dg JOIN tg USING (s) JOIN grid USING (name)),
per AS (
  SELECT doc_id, name, k, j * step AS spot, count(DISTINCT s) AS n
  FROM (SELECT *, unnest(range(CASE WHEN p < win THEN 0 ELSE (p - win) // step + 1 END, p // step + 1)) AS j FROM hit)
  GROUP BY doc_id, name, k, step, j
),
found AS (SELECT * FROM per WHERE n * 100 >= {percent} * k),
agg AS (SELECT doc_id, count(DISTINCT name) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names, max(n / k) AS best, min(spot) AS spot FROM found GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_licenses, coalesce(names, '') AS licenses, best::DOUBLE AS containment, spot::BIGINT AS first_window
FROM dw LEFT JOIN agg USING (doc_id)
"""
