"""License scans: an exact set-similarity join of text blocks with license templates.

DataFrame functions only. A text's words are cut into overlapping blocks; a
block's set joins a template's when it holds at least `need` of its words
(containment). Tokens are ordered by their frequency in the whole corpus, rarest
first, and three filters go before the count of common words:

* prefix: a block must hold one of a template's len - need + 1 rarest words;
* length: it must hold `need` words of any template's vocabulary at all;
* position: from the first common word on, both sides must have enough words left.

The templates are constants, so the join's smaller side is a literal of known
size and the join needs no shuffle; only the corpus's counts of the templates'
few hundred words do. Every expression that is used twice is bound once by a
lambda, as a projection that is inlined into a lambda would run for each element.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that are in no token; A-Z are lower-cased before.
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A block starts every STRIDE words and is WIDTH long: any run of WIDTH - STRIDE + 1 words lies in one.
STRIDE, WIDTH = 64, 128

#: Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices and their labels.
NOTICES = {
    "gpl-notice": "this work is licensed under the gnu general public license version 3",
    "lgpl-notice": "licensed under the gnu lesser general public license",
    "agpl-notice": "licensed under the gnu affero general public license",
    "apache-notice": "licensed under the apache license version 2 0",
    "mit-notice": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-notice": "licensed under cc by 4 0",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-sa-notice": "licensed under cc by sa 4 0",
    "cc-text": "this work is licensed under a creative commons attribution 4 0 international license",
    "unlicense-text": "this is free and unencumbered software released into the public domain",
    "rights-reserved": "copyright all rights reserved",
    "apache-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "apache-terms": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl-header": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "mit-rights": "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "bsd-conditions": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
}
#: A notice is found where a block holds this share of its distinct words.
CONTAINMENT = 0.8


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    phrase: bool  # its words must also stand consecutively

    @property
    def tokens(self) -> list[str]:
        return sorted(set(self.words))

    @property
    def need(self) -> int:
        return len(self.tokens) if self.phrase else math.ceil(round(CONTAINMENT * len(self.tokens), 9))


TEMPLATES = [Template(label, tuple(p.split()), True) for p, label in PHRASES.items()] + [Template(k, tuple(t.split()), False) for k, t in NOTICES.items()]


def templates_of(notices: dict[str, str]) -> list[Template]:
    """TEMPLATES and notices of one's own, by label, in any case and punctuation; of at most WIDTH - STRIDE + 1 words each, so that one block holds them whole."""
    out = list(TEMPLATES)
    for label, text in notices.items():
        own = tuple(w for w in re.split(SPLIT, text.translate({c: c + 32 for c in range(0x41, 0x5B)})) if w)
        if not 0 < len(own) <= WIDTH - STRIDE + 1:
            raise ValueError(f"notice {label!r} has {len(own)} words; cut it into parts of 1 to {WIDTH - STRIDE + 1}")
        out.append(Template(label, own, False))
    return out


def _vocabulary(templates: list[Template]) -> list[str]:
    return sorted({w for t in templates for w in t.words})


def _let(value: Column, body) -> Column:
    """Evaluates `value` once and gives it to `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: str | Column) -> Column:
    """Words of a text in order; of a null text none."""
    text = F.col(text) if isinstance(text, str) else text
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), SPLIT), lambda w: w != "")


def frequencies(docs: DataFrame, text_col: str = "text", templates: list[Template] = TEMPLATES) -> dict[str, int]:
    """Occurrences of each template word in all documents: a row per word of the templates at most."""
    rows = docs.select(F.explode(words(text_col)).alias("w")).where(F.col("w").isin(_vocabulary(templates))).groupBy("w").count().collect()
    return {r.w: r["count"] for r in rows}


def _found(block: Column, order: list[str], templates: list[Template]) -> Column:
    """Templates that the block joins: struct(index, share)."""
    rank = {w: i for i, w in enumerate(order)}
    sides = []
    for i, t in enumerate(templates):
        tokens = sorted(t.tokens, key=rank.__getitem__)
        sides.append(F.struct(F.lit(i).alias("i"), F.lit(t.need).alias("need"), F.lit(len(tokens)).alias("n"), F.lit(tokens).alias("tokens"), F.lit(tokens[: len(tokens) - t.need + 1]).alias("prefix")))

    def joined(own: Column) -> Column:
        def passes(t: Column) -> Column:
            def left(w: Column) -> Column:  # words that both sides still have from w on
                return F.least(t["n"] - F.array_position(t["tokens"], w), F.size(own) - F.array_position(own, w)) + 1

            return (F.size(own) >= t["need"]) & F.exists(t["prefix"], lambda w: F.array_contains(own, w) & (left(w) >= t["need"]))

        counted = F.transform(F.filter(F.array(*sides), passes), lambda t: F.struct(t["i"].alias("i"), F.size(F.array_intersect(t["tokens"], own)).alias("common"), t["need"].alias("need"), t["n"].alias("n")))
        return F.transform(F.filter(counted, lambda c: c["common"] >= c["need"]), lambda c: F.struct(c["i"].alias("i"), (c["common"] / c["n"]).alias("share")))

    return _let(F.array_intersect(F.lit(order), block), joined)


def _places(at: Column, block: Column, found: Column, templates: list[Template]) -> Column:
    """Where phrases stand, of those that start in the block's own stride: struct(word, label)."""
    def of(i: int, t: Template) -> Column:
        n, phrase = len(t.words), F.lit(list(t.words))
        last = F.least(F.lit(STRIDE), F.size(block) - n + 1)
        starts = F.when(F.exists(found, lambda f: f["i"] == i) & (last > 0), F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        hits = F.filter(starts, lambda s: F.slice(block, s + 1, n) == phrase)
        return F.transform(hits, lambda s: F.struct((at + s).cast("long").alias("word"), F.lit(t.label).alias("label")))

    return F.concat(*(of(i, t) for i, t in enumerate(templates) if t.phrase))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[Template] = TEMPLATES) -> DataFrame:
    """Per document: words, places of base phrases, labels, score, and the blocks found.

    score is the largest share of a template's words that a block which joins it
    holds; 0 without one. blocks lists (first word, label, share). Null and empty
    texts have no words and no labels; repeated rows each get a row; ties of
    frequency are broken by the word; other columns aren't read. The texts are
    read twice, once to count the templates' words. A text's words and blocks are
    one value in memory, of some 100 bytes a word. templates: see templates_of().
    """
    count = frequencies(docs, text_col, templates)
    order = sorted(_vocabulary(templates), key=lambda w: (count.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    prefixes = sorted({w for t in templates for w in sorted(t.tokens, key=rank.__getitem__)[: len(t.tokens) - t.need + 1]})
    labels = F.lit([t.label for t in templates])
    phrases = F.lit([t.phrase for t in templates])

    def blocks(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(STRIDE))
        all_ = F.transform(starts, lambda k: F.struct(k.alias("at"), F.slice(w, k + 1, WIDTH).alias("words")))
        held = F.filter(all_, lambda b: F.arrays_overlap(b["words"], F.lit(prefixes)))
        joined = F.transform(held, lambda b: F.struct(b["at"].alias("at"), b["words"].alias("words"), _found(b["words"], order, templates).alias("found")))
        return F.filter(joined, lambda b: F.size(b["found"]) > 0)

    def digest(w: Column) -> Column:
        return _let(
            blocks(w),
            lambda bs: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.flatten(F.transform(bs, lambda b: _places(b["at"], b["words"], b["found"], templates))).alias("places"),
                F.flatten(F.transform(bs, lambda b: F.transform(b["found"], lambda f: F.struct(b["at"].cast("long").alias("word"), F.element_at(labels, f["i"] + 1).alias("label"), f["share"].alias("share"), F.element_at(phrases, f["i"] + 1).alias("phrase"))))).alias("found"),
            ),
        )

    x = docs.select(F.col(id_col).alias("doc_id"), _let(words(text_col), digest).alias("x"))
    base = F.transform("x.places", lambda p: p["label"])
    own = F.filter("x.found", lambda f: ~f["phrase"])
    both = F.concat(base, F.transform(own, lambda f: f["label"]))
    return x.select(
        "doc_id",
        F.col("x.n_words").alias("n_words"),
        F.size("x.places").cast("long").alias("n_base"),
        F.array_min(F.transform("x.places", lambda p: p["word"])).alias("first_word"),
        F.array_max(F.transform("x.places", lambda p: p["word"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(both)), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("x.found", lambda f: f["share"])), F.lit(0.0)).alias("score"),
        F.transform(own, lambda f: F.struct(f["word"].alias("word"), f["label"].alias("label"), f["share"].alias("share"))).alias("blocks"),
    )


def oracle_sql(templates: list[Template] = TEMPLATES) -> str:
    """The scan in DuckDB SQL, by comparing every block with every template."""
    rows = ", ".join(f"({i}, '{t.label}', {'true' if t.phrase else 'false'}, {list(t.words)}, {t.tokens}, {t.need})" for i, t in enumerate(templates))
    return f"""
WITH templates(i, label, phrase, words, tokens, need) AS (VALUES {rows}),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
blocks AS (SELECT r, k AS pos, w[k + 1 : k + {WIDTH}] AS b FROM (SELECT r, w, unnest(generate_series(0, greatest(len(w) - 1, 0), {STRIDE})) AS k FROM docs)),
found AS (SELECT r, pos, label, phrase, len(list_intersect(tokens, b)) / len(tokens) AS share FROM blocks, templates WHERE len(list_intersect(tokens, b)) >= need),
places AS (SELECT r, label, s AS word FROM (SELECT r, label, words, w, unnest(generate_series(0, len(w) - len(words))) AS s FROM docs, templates WHERE phrase AND len(w) >= len(words)) WHERE w[s + 1] = words[1] AND w[s + 1 : s + len(words)] = words),
p AS (SELECT r, count(*) AS n, min(word) AS a, max(word) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY r),
l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM found WHERE NOT phrase UNION ALL SELECT r, label FROM places) GROUP BY r),
s AS (SELECT r, max(share) AS share FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(p.n, 0) AS BIGINT) AS n_base, CAST(p.a AS BIGINT) AS first_word, CAST(p.z AS BIGINT) AS last_word,
       coalesce(p.labels, '') AS base_labels, coalesce(l.labels, '') AS labels, CAST(coalesce(s.share, 0) AS DOUBLE) AS score
FROM docs LEFT JOIN p USING (r) LEFT JOIN l USING (r) LEFT JOIN s USING (r)
"""
