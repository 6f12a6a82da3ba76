"""License scans by an exact set-similarity join of text blocks and templates.

Templates are whole notices and license texts. A template of up to c words, c a power of two, is sought in blocks of 2c consecutive
words, a new one beginning each c words, so every run of up to c words lies whole in some block, however long a template is.
A template is found in a block that holds at least the share ``threshold`` of its distinct words. Words are ordered by how
many documents hold them, rarest first; a block can only qualify if it holds a word of the
template's prefix, is long enough, and if the words left after the first shared one suffice.
Blocks without a prefix word are never built. Of templates found in the same or overlapping blocks one goes if another explains all its
words and more, or the same words as a greater share: so the notice of a variant of a license is not taken for the license itself.

A few common words do not tell a license: templates of fewer than ``LEAST_WORDS`` distinct words are phrases, whose words must stand consecutively.

Defined cases: a null or empty text has no words and no labels; repeated rows are scanned each;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import as_bytes, map_columns, table, words_of

# The base phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: The texts and notices that public licenses ask for, and names of further licenses, each with its label.
TEMPLATES = (
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("bsd license", "bsd"),
    ("isc license", "isc"),
    ("creative commons attribution", "cc-by"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "mit",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy "
        "of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under "
        "the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the "
        "specific language governing permissions and limitations under the license",
        "apache",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
        "free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it "
        "will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu "
        "general public license for more details",
        "gpl",
    ),
    (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by "
        "the free software foundation either version 2 1 of the license or at your option any later version this library is distributed in the hope that "
        "it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu "
        "lesser general public license for more details",
        "lgpl",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by "
        "the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that "
        "it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu "
        "lesser general public license for more details",
        "lgpl",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by "
        "the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that "
        "it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu "
        "affero general public license for more details",
        "agpl",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in "
        "binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other "
        "materials provided with the distribution",
        "bsd",
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you "
        "can obtain one at http mozilla org mpl 2 0",
        "mpl",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies",
        "isc",
    ),
)
THRESHOLD = 0.8
#: Distinct words from which a template is sought as a set.
LEAST_WORDS = 15

FOUND = T.StructType([
    T.StructField("n_words", T.LongType(), False),
    T.StructField("n_base", T.LongType(), False),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.ArrayType(T.StringType(), False), False),
    T.StructField("labels", T.ArrayType(T.StringType(), False), False),
    T.StructField("score", T.DoubleType(), False),
])


def document_counts(df: DataFrame, text: str, words: set[bytes]) -> dict[bytes, int]:
    """How many rows of ``df`` hold each of ``words``; the result has no more entries than those."""

    def run(batches):
        counts = dict.fromkeys(words, 0)
        for batch in batches:
            for data in as_bytes(batch.column(0)):
                for word in words.intersection(words_of(data)):
                    counts[word] += 1
        held = [(w, n) for w, n in counts.items() if n]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in held], pa.binary()), pa.array([n for _, n in held], pa.int64())], names=["word", "n"])

    parts = df.select(F.col(text)).mapInArrow(run, "word binary, n long")
    return {bytes(r.word): r.n for r in parts.groupBy("word").agg(F.sum("n").alias("n")).collect()}


class TemplateIndex:
    """Templates as sets of words numbered from the rarest, with their prefixes by the blocks that they are sought in."""

    def __init__(self, templates, counts: dict[bytes, int], threshold: float) -> None:
        lists = [words_of(text.encode()) for text, _ in templates]
        sets = [set(words) for words in lists]
        order = sorted(set().union(*sets), key=lambda w: (counts.get(w, 0), w))
        self.number = {w: i + 1 for i, w in enumerate(order)}
        self.labels = [label for _, label in templates]
        self.sizes = [len(s) for s in sets]
        self.least = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in sets]
        self.words = [sorted(self.number[w] for w in s) for s in sets]
        #: By half a block's words: (template, position) of each prefix word.
        self.prefix: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for i, words in enumerate(self.words):
            of = self.prefix.setdefault(half_block(lists[i]), {})
            for at, word in enumerate(words[: len(words) - self.least[i] + 1]):
                of.setdefault(word, []).append((i, at))
        self.rare = {half: np.isin(np.arange(len(self.number) + 1), list(of)) for half, of in self.prefix.items()}

    def search(self, words: list[bytes]) -> dict[int, float]:
        """The greatest containment of each template found in the text that no other one explains."""
        number = self.number.get
        ids = np.fromiter((number(w, 0) for w in words), np.int64, len(words))
        best: dict[int, float] = {}
        for half, rare in self.rare.items():
            at = np.flatnonzero(rare[ids])
            if not len(at):
                continue
            starts = {b * half for p in (at // half).tolist() for b in (p - 1, p) if b >= 0}
            hits = [(start, i, shared) for start in sorted(starts) for i, shared in self._block(ids[start : start + 2 * half], half)]
            for start, i, shared in hits:
                share = len(shared) / self.sizes[i]
                rivals = (h for h in hits if h[1] != i and abs(h[0] - start) <= half)
                if not any(shared < other or (shared == other and (len(other) / self.sizes[j], -j) > (share, -i)) for _, j, other in rivals):
                    best[i] = max(best.get(i, 0.0), share)
        return best

    def _block(self, ids: np.ndarray, half: int) -> list[tuple[int, frozenset[int]]]:
        """Templates found in a block, each with its words that the block holds."""
        held = np.unique(ids)
        held = held[held > 0].tolist()
        tried: set[int] = set()
        found = []
        for j, word in enumerate(held):
            for i, k in self.prefix[half].get(word, ()):
                if i in tried:
                    continue
                tried.add(i)  # words are met in the global order, so this is the first shared one
                least = self.least[i]
                if len(held) < least or 1 + min(len(held) - j - 1, self.sizes[i] - k - 1) < least:
                    continue
                shared = frozenset(held[j:]).intersection(self.words[i])
                if len(shared) >= least:
                    found.append((i, shared))
        return found


def half_block(words: list[bytes]) -> int:
    """Half the words of the blocks that a template is sought in: a power of two, at least its own."""
    return 1 << max(4, (len(words) - 1).bit_length())


def phrase_places(words: list[bytes], phrases) -> list[tuple[int, str]]:
    """(first word, label) of each place where a phrase's words stand consecutively."""
    line = b" " + b" ".join(words) + b" "
    places = []
    for phrase, label in phrases:
        sought = b" " + phrase.encode() + b" "
        at, word, last = line.find(sought), 0, 0
        while at >= 0:
            word += line.count(b" ", last, at)
            last = at
            places.append((word, label))
            at = line.find(sought, at + 1)
    return places


def license_scan(df: DataFrame, key: str, text: str, *, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per row of ``df``: ``key``, word and place counts, labels and a score.

    ``score`` is 1 where a phrase stands, else the greatest containment of a template found. The templates are
    sent to executors whole, so their size is the caller's to bound.
    """
    short = [len(set(words_of(t.encode()))) < least_words for t, _ in templates]
    more = [t for t, s in zip(templates, short, strict=True) if s]
    whole = [t for t, s in zip(templates, short, strict=True) if not s]
    words = set().union(*(words_of(t.encode()) for t, _ in whole))
    index = df.sparkSession.sparkContext.broadcast(TemplateIndex(whole, document_counts(df, text, words), threshold))

    def make():
        join = index.value

        def fn(texts: pa.Array) -> list[pa.Array]:
            rows = []
            for data in as_bytes(texts):
                found = words_of(data)
                places, named = phrase_places(found, phrases), phrase_places(found, more)
                best = join.search(found)
                base = {label for _, label in places}
                at = [p for p, _ in places]
                score = 1.0 if places or named else max(best.values(), default=0.0)
                labels = base | {label for _, label in named} | {join.labels[i] for i in best}
                rows.append((len(found), len(places), min(at, default=None), max(at, default=None), sorted(base), sorted(labels), score))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.float64())
            return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]

        return fn

    return map_columns(df, [F.col(key)], [F.col(text)], make, FOUND).withColumnRenamed("c0", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)


_DISTINCT = [len(set(t.split())) for t, _ in TEMPLATES]
_SOUGHT = [(t, label, 1) for t, label in PHRASES] + [(t, label, 0) for (t, label), n in zip(TEMPLATES, _DISTINCT, strict=True) if n < LEAST_WORDS]
_SETS = [(i, t, label, half_block(words_of(t.encode()))) for i, ((t, label), n) in enumerate(zip(TEMPLATES, _DISTINCT, strict=True)) if n >= LEAST_WORDS]
SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), p(phrase, label, base) AS (VALUES {_values(_SOUGHT)}
), q AS (
  SELECT r, label, base, i FROM (
    SELECT r, w, label, base, string_split(phrase, ' ') AS ws, unnest(range(1, len(w) + 1)) AS i FROM d, p
    WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' ' || phrase || ' ')
  ) WHERE list_slice(w, i, i + len(ws) - 1) = ws
), t(t, text, label, half) AS (VALUES {_values(_SETS)}
), u AS (
  SELECT r, t, label, half, ws, start, list_intersect(ws, list_slice(w, start + 1, start + 2 * half)) AS shared
  FROM (SELECT d.r, d.w, t.t, t.label, t.half, list_distinct(string_split(t.text, ' ')) AS ws, unnest(range(0, len(d.w), t.half)) AS start FROM d, t)
), h AS (
  SELECT *, CAST(len(shared) AS DOUBLE) / len(ws) AS share FROM u WHERE 5 * len(shared) >= 4 * len(ws)
), k AS (
  SELECT r, label, share FROM h AS x WHERE NOT EXISTS (
    SELECT 1 FROM h AS y WHERE y.r = x.r AND y.half = x.half AND y.t <> x.t AND abs(y.start - x.start) <= x.half AND list_has_all(y.shared, x.shared)
      AND (len(y.shared) > len(x.shared) OR y.share > x.share OR (y.share = x.share AND y.t < x.t)))
), b AS (
  SELECT r, count(*) AS n, min(i) - 1 AS low, max(i) - 1 AS high FROM q WHERE base = 1 GROUP BY r
), n AS (
  SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT r, label FROM q WHERE base = 1) GROUP BY r
), m AS (
  SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM q UNION SELECT r, label FROM k) GROUP BY r
), o AS (
  SELECT r, max(share) AS score FROM (SELECT r, 1.0::DOUBLE AS share FROM q UNION ALL SELECT r, share FROM k) GROUP BY r
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, b.low AS first_word, b.high AS last_word,
       coalesce(n.labels, '') AS base_labels, coalesce(m.labels, '') AS labels, coalesce(o.score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN n USING (r) LEFT JOIN m USING (r) LEFT JOIN o USING (r)
"""


def brute_force(text: str | None, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD, least_words: int = LEAST_WORDS) -> tuple:
    """n_words, n_base, first_word, last_word, base labels, labels and score of a text, by trying all templates at all blocks; for tests."""
    words = words_of((text or "").encode())
    stands = lambda some: sorted((i, label) for t, label in some for w in [t.encode().split()] for i in range(len(words)) if words[i : i + len(w)] == w)
    sets = [(set(words_of(t.encode())), half_block(words_of(t.encode())), label) for t, label in templates]
    base, named = stands(phrases), stands([t for t, (s, _, _) in zip(templates, sets, strict=True) if len(s) < least_words])
    hits = []
    for i, (own, half, _) in enumerate(sets):
        if len(own) >= least_words:
            for start in range(0, len(words), half):
                shared = own & set(words[start : start + 2 * half])
                if len(shared) >= threshold * len(own) - 1e-9:
                    hits.append((half, start, i, shared, len(shared) / len(own)))
    kept = [x for x in hits if not any(y[2] != x[2] and y[0] == x[0] and abs(y[1] - x[1]) <= x[0] and (x[3] < y[3] or (x[3] == y[3] and (y[4], -y[2]) > (x[4], -x[2]))) for y in hits)]
    labels = {label for _, label in base + named} | {sets[i][2] for _, _, i, _, _ in kept}
    at = [i for i, _ in base]
    score = 1.0 if base or named else max((x[4] for x in kept), default=0.0)
    return len(words), len(base), min(at, default=None), max(at, default=None), sorted({x for _, x in base}), sorted(labels), score
