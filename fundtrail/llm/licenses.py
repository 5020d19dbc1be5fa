"""License scan by diagonal voting.

Every run of k words of every text and of every template is hashed; Spark joins the two on the hash. A hit
at word p of a text and word q of a template votes for the diagonal p - q, the place where the template
would start. A short phrase is found where one diagonal holds a vote from each of its k-grams. For
longer templates, diagonals at most ``DRIFT`` apart are merged, which bridges words put in or left out. A
merged span reaches over the whole template on its diagonals and ``DRIFT`` words more, and counts when the template's words
recur in its text in order to at least ``COVER``. Both kinds are verified on the words of the text before they count. One
k-gram left whole is enough for a span; a notice without any is not seen.

A null or empty text has no words, places or labels. Rows with one doc_id and one text are scanned once and
returned as often as they stand; an empty table gives an empty result. Overlapping places all count.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .text import ALNUM, chunks, signed

K = 3
DRIFT = 4
COVER = 0.75
#: Documents with a candidate span are verified by a broadcast of their keys up to this many, else by a join.
MAX_BROADCAST = 200_000
DOC_GRAM = 0  # hash of the row that stands for the document itself


@dataclass(frozen=True)
class Template:
    """``exact``: a phrase whose words stand consecutively; otherwise a longer text that may vary."""

    label: str
    text: str
    exact: bool = False


# Phrases of the base scan.
BASE = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)
# Sentences of published license notices.
NOTICES = (
    Template("gpl-3", "licensed under the gnu general public license version 3"),
    Template("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license"),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    Template("agpl-3", "licensed under the gnu affero general public license version 3"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
)


def template_grams(templates: Sequence[Template]) -> list[tuple[int, int, int]]:
    """(gram, template, word of the template) of every k-gram, and the row that documents themselves match."""
    out = [(DOC_GRAM, -1, 0)]
    for i, t in enumerate(templates):
        for c in chunks(pa.array([t.text])):
            h, at, _ = c.lower().words(ALNUM).shingles(K)
            if not len(h):
                raise ValueError(f"template {t.label!r} has fewer than {K} words")
            out += [(int(g), i, int(p)) for g, p in zip(signed(h), at, strict=True)]
    return out


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All k-gram hashes of each text, in order, after the row that stands for the text."""
    for batch in batches:
        for c in chunks(batch.column("text")):
            w = c.lower().words(ALNUM)
            h, _, doc = w.shingles(K)
            counts = np.maximum(w.counts - K + 1, 0) + 1
            first = np.concatenate([[0], np.cumsum(counts)])
            values = np.full(first[-1], DOC_GRAM, dtype=np.int64)
            values[np.arange(len(h)) + doc + 1] = signed(h)
            column = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(c.row, len(c)), batch.column("key").slice(c.row, len(c)), pa.array(w.counts.astype(np.int64)), column],
                names=["doc_id", "key", "n_words", "grams"],
            )


def hits(docs: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """(doc_id, key, n_words, template, at, diagonal): text k-grams joined to template positions.

    Template -1 marks the document. The template side has one row per template word.
    """
    grams = docs.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(_grams, "doc_id long, key long, n_words long, grams array<long>")
    rows = grams.select("doc_id", "key", "n_words", F.posexplode("grams").alias("at", "gram"))
    places = docs.sparkSession.createDataFrame(template_grams(templates), "gram long, template int, word int")
    return rows.join(F.broadcast(places), "gram").select(
        "doc_id", "key", "n_words", "template", (F.col("at") - 1).alias("at"), (F.col("at") - 1 - F.col("word")).alias("diagonal")
    )


def spans(votes: DataFrame, size: Column) -> DataFrame:
    """(doc_id, key, template, start, stop): diagonals, neighbours merged, with the words where a template of ``size`` words may lie.

    Diagonals are far fewer than words: only k-grams that a template has get here.
    """
    per = votes.groupBy("doc_id", "key", "template", "diagonal").agg(F.min("at").alias("a"), F.max("at").alias("b"))
    order = Window.partitionBy("doc_id", "key", "template").orderBy("a", "diagonal")
    previous_end = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > DRIFT) | (F.col("a") > previous_end + K + DRIFT)
    run = F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(order)
    return (
        per.withColumn("run", run).groupBy("doc_id", "key", "template", "run")
        .agg((F.min("diagonal") - DRIFT).alias("start"), (F.max("diagonal") + F.max(size) + DRIFT).alias("stop"))
    )


def _verify(templates: Sequence[Template]):
    words = [t.text.split() for t in templates]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["doc_id", "key", "spans"]).to_pylist()
            out = []
            for c in chunks(batch.column("text")):
                low = c.lower()
                w = low.words(ALNUM)
                for d in range(len(c)):
                    r, base = rows[c.row + d], int(w.first[d])
                    word = lambda i: low.bytes[w.starts[base + i] : w.ends[base + i]].tobytes().decode()
                    looser = []
                    for s in r["spans"]:
                        t = words[s["template"]]
                        if templates[s["template"]].exact:
                            a, n = s["start"], len(t)
                            found = 1.0 if a >= 0 and a + n <= w.counts[d] and [word(i) for i in range(a, a + n)] == t else 0.0
                        else:
                            a = max(s["start"], 0)
                            text = [word(i) for i in range(a, min(s["stop"], int(w.counts[d])))]
                            same = [m for m in SequenceMatcher(None, text, t, autojunk=False).get_matching_blocks() if m.size]
                            found = sum(m.size for m in same) / len(t)
                            if found >= COVER:
                                looser.append((found, s | {"start": a + same[0].a, "stop": a + same[-1].a + same[-1].size}))
                            continue
                        out.append((r["doc_id"], r["key"], s["template"], s["start"], found))
                    taken: list[dict] = []  # of notices found at one place, with more than chance words in common, the closest counts
                    for found, s in sorted(looser, key=lambda x: (-x[0], x[1]["template"], x[1]["start"])):
                        if all(min(s["stop"], o["stop"]) - max(s["start"], o["start"]) <= DRIFT for o in taken):
                            taken.append(s)
                            out.append((r["doc_id"], r["key"], s["template"], s["start"], found))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, types, strict=True)], names=["doc_id", "key", "template", "start", "cover"])

    return run


def scan(docs: DataFrame, base: Sequence[Template] = BASE, notices: Sequence[Template] = NOTICES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of ``docs``."""
    templates = [*base, *notices]
    docs = docs.select("doc_id", "text")
    found = materialize(hits(docs, templates), "license-hits")
    rows = found.where("template = -1").groupBy("doc_id", "key", "n_words").agg(F.count(F.lit(1)).alias("n_rows"))
    votes = found.where("template >= 0")

    grams = {i: len(t.text.split()) - K + 1 for i, t in enumerate(templates)}
    size = F.create_map(*[F.lit(x) for pair in grams.items() for x in pair])
    exact = F.col("template") < len(base)
    phrases = (
        votes.where(exact).groupBy("doc_id", "key", "template", "diagonal").agg(F.countDistinct("at").alias("v"))
        .where(F.col("v") == F.element_at(size, F.col("template")))
        .select("doc_id", "key", "template", F.col("diagonal").cast("long").alias("start"), F.col("diagonal").cast("long").alias("stop"))
    )
    longer = spans(votes.where(~exact), F.element_at(size, F.col("template")) + K - 1)
    candidates = phrases.unionByName(longer.select("doc_id", "key", "template", F.col("start").cast("long"), F.col("stop").cast("long")))
    per_doc = materialize(
        candidates.groupBy("doc_id", "key").agg(F.collect_list(F.struct("template", "start", "stop")).alias("spans")), "license-candidates"
    )
    texts = docs.withColumn("key", F.xxhash64("text")).withColumn("_id", F.coalesce("doc_id", F.lit(-1)))
    small = per_doc.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    wanted = per_doc.withColumn("_id", F.coalesce("doc_id", F.lit(-1))).drop("doc_id")
    verified = (
        texts.join(F.broadcast(wanted) if small else wanted, ["_id", "key"])
        .select("doc_id", "key", "spans", "text")
        .mapInArrow(_verify(templates), "doc_id long, key long, template int, start long, cover double")
        .distinct()
    )
    label = F.element_at(F.array(*[F.lit(t.label) for t in templates]), F.col("template") + 1)
    true_base = (F.col("template") < len(base)) & (F.col("cover") == 1.0)
    true_any = true_base | ((F.col("template") >= len(base)) & (F.col("cover") >= COVER))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    result = verified.groupBy("doc_id", "key").agg(
        F.count(F.when(true_base, 1)).alias("n_base"),
        F.min(F.when(true_base, F.col("start"))).alias("first_word"),
        F.max(F.when(true_base, F.col("start"))).alias("last_word"),
        joined(F.when(true_base, label)).alias("base_labels"),
        joined(F.when(true_any, label)).alias("labels"),
        F.max(F.when(true_any, F.least(F.col("cover"), F.lit(1.0)))).alias("score"),
    )
    rows, result = rows.alias("r"), result.alias("f")
    every = rows.join(result, F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("r.key") == F.col("f.key")), "left")
    return every.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int")))).select(
        "r.doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
