"""License scans: a positional index of rare licence words, in DataFrame expressions only."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Fixed phrases and labels that every scan reports.
BASE = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}

#: (label, mandatory key phrase, words that follow it in the notice); fixed texts of public notices.
NOTICES = [
    ("all-rights-reserved", "all rights reserved", ""),
    ("apache-2", "you may not use this file except in compliance with the license", "you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms", "with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "creative commons attribution", "4 0 international license"),
    ("gpl", "under the terms of the gnu general public license", "as published by the free software foundation"),
    ("gpl-3", "gnu general public license version 3", ""),
    ("isc", "permission to use copy modify and or distribute this software", "for any purpose with or without fee is hereby granted"),
    ("lgpl", "gnu lesser general public license", ""),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "of this software and associated documentation files"),
    ("mpl-2", "mozilla public license", "version 2 0"),
    ("unlicense", "this is free and unencumbered software", "released into the public domain"),
]


def templates() -> list[dict]:
    """Every template: label, whether it is a base phrase, its words in order, and how many of the first are mandatory."""
    rows = [{"label": k, "base": True, "words": v.split(), "must": len(v.split())} for k, v in BASE.items()]
    return rows + [{"label": k, "base": False, "words": [*v.split(), *rest.split()], "must": len(v.split())} for k, v, rest in NOTICES]


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words and, in text order, the places of licence words: ``hits array<struct<w, at>>``."""
    known = sorted({w for t in templates() for w in t["words"]})
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER), F.lit(f"({WORD})"), F.lit(1))
    placed = F.transform(F.col("_words"), lambda w, i: F.struct(w.alias("w"), i.alias("at")))
    return (
        docs.select(F.col(id_col).alias("doc_id"), words.alias("_words"))
        .select("doc_id", F.size("_words").cast("long").alias("n_words"), F.filter(placed, lambda x: x["w"].isin(known)).alias("hits"))
    )


def rarity(index: DataFrame) -> dict[str, float]:
    """Inverse document frequency of each licence word over all documents; a few dozen numbers at most."""
    rows = (
        index.select(F.explode(F.array_distinct(F.transform("hits", lambda x: x["w"]))).alias("w"))
        .groupBy("w").agg(F.count("*").alias("df")).collect()
    )
    n = index.count()
    found = {r["w"]: r["df"] for r in rows}
    return {w: math.log((n + 1) / (found.get(w, 0) + 1)) for t in templates() for w in t["words"]}


#: Starts that the postings of one template word vote for.
_PLACES = "transform(filter(hits, x -> x.w = {w}), x -> x.at - {r})"


def _index(idf: dict[str, float]) -> Column:
    """The templates as one constant: ``order`` has the places of the mandatory words, rarest first."""
    rows = []
    for t in templates():
        order = sorted(range(t["must"]), key=lambda r: (-idf[t["words"][r]], r))
        rows.append(t | {"order": order, "rest": list(range(t["must"], len(t["words"])))})
    kind = "array<struct<label: string, base: boolean, words: array<string>, must: int, order: array<int>, rest: array<int>>>"
    return F.from_json(F.lit(json.dumps(rows)), kind)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence phrases of every document.

    Words are lower-cased (A-Z) runs of ``WORD``; a null text has none. A
    template is a candidate if its rarest key word occurs in the file; it holds at
    a start if all words of its key phrase stand there. The postings of its key
    words are intersected by relative position, rarest first, so each file costs
    time linear in its licence words. Rows with equal ids are scanned apart.
    An empty table gives no rows; texts of any length are taken whole; other
    columns, whatever their names, are not read.

    Returns doc_id, n_words, n_base (places of base phrases), first_word and
    last_word (smallest and largest start of those, else null), base_labels,
    labels (distinct, sorted, comma-joined), score (largest share of a found
    template's words that stand at their place; 0 without any label).
    """
    index = stage(postings(docs, id_col, text_col), "license-postings")
    first = _PLACES.format(w="t.words[t.order[0]]", r="t.order[0]")
    starts = f"aggregate(slice(t.order, 2, size(t.order)), {first}, (acc, r) -> array_intersect(acc, {_PLACES.format(w='t.words[r]', r='r')}))"
    found = f"""filter(transform(filter(tpl, t -> array_contains(present, t.words[t.order[0]])),
        t -> struct(t.label AS label, t.base AS base, t.words AS words, t.must AS must, t.rest AS rest, {starts} AS starts)), f -> size(f.starts) > 0)"""
    covered = f"(f.must + size(filter(f.rest, r -> size(array_intersect(f.starts, {_PLACES.format(w='f.words[r]', r='r')})) > 0))) / cast(size(f.words) AS double)"
    names = "array_join(array_sort(array_distinct(transform({}, f -> f.label))), ',')"
    return (
        index.select("doc_id", "n_words", "hits", F.array_distinct(F.transform("hits", lambda x: x["w"])).alias("present"), _index(rarity(index)).alias("tpl"))
        .select("doc_id", "n_words", "hits", F.expr(found).alias("found"))
        .select("*", F.expr("flatten(transform(filter(found, f -> f.base), f -> f.starts))").alias("places"))
        .select(
            "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
            F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
            F.expr(names.format("filter(found, f -> f.base)")).alias("base_labels"), F.expr(names.format("found")).alias("labels"),
            F.expr(f"coalesce(array_max(transform(found, f -> {covered})), 0D)").alias("score"),
        )
    )


def oracle() -> str:
    """The same result without an index: every word is compared with every template word."""
    rows = ",".join(f"({k},'{t['label']}',{str(t['base']).lower()},{len(t['words'])},{t['must']},{r},'{w}')" for k, t in enumerate(templates()) for r, w in enumerate(t["words"]))
    return f"""
WITH t(k, label, base, len, must, rel, w) AS (VALUES {rows}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'{UPPER}','{LOWER}'), '{WORD}') AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM d),
m AS (SELECT doc_id, k, label, base, len, must, pos - rel AS s, rel FROM p JOIN t USING (w)),
v AS (SELECT doc_id, k, s FROM m WHERE rel < must GROUP BY doc_id, k, s, must HAVING count(*) = must),
f AS (SELECT doc_id, k, label, base, max(len) AS len, count(DISTINCT rel) AS got FROM m JOIN v USING (doc_id, k, s) GROUP BY ALL),
b AS (SELECT doc_id, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word FROM v JOIN (SELECT DISTINCT k FROM t WHERE base) USING (k) GROUP BY doc_id),
g AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(got / len) AS score FROM f GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN g USING (doc_id)"""
