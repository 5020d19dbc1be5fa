"""Quality rules as a short-circuit cascade.

``measure`` gives the base figures of every document. ``Cascade`` holds further rules, each a function
of a chunk that marks the documents it rejects. ``ordered`` times every rule on a bounded
sample and sorts them by rejections per second; in a chunk each rule then sees only the
documents that all earlier ones kept. A document is kept when no rule rejects it, so the order changes
the time and never the result.

Null and empty texts have no words; they fail the base rules. Repeated rows are judged alike; an empty
table gives an empty result. Texts are never cut, and whole documents are compared with themselves only.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import NON_SPACE, Chunk, chunks, mix

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
SAMPLE_DOCS = 2_000
WINDOW = 5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def per_doc_ratio(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Marks every key that occurs more than once."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    flag = np.zeros(len(keys), dtype=bool)
    flag[order[1:][same]] = True
    flag[order[:-1][same]] = True
    return flag


def word_counts(c: Chunk) -> np.ndarray:
    return c.words(NON_SPACE).counts


def word_chars(c: Chunk) -> np.ndarray:
    return c.sums(NON_SPACE[c.bytes] & ((c.bytes & 0xC0) != 0x80))


def symbols(c: Chunk) -> np.ndarray:
    return c.sums(SYMBOLS[c.bytes])


def lines(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word of each document, and those among them equal to an earlier one."""
    starts, ends, first = c.runs(c.bytes != 0x0A)
    doc = np.repeat(np.arange(len(c)), np.diff(first))
    words = np.concatenate([[0], np.cumsum(NON_SPACE[c.bytes])])
    full = words[ends] > words[starts]
    n = np.bincount(doc[full], minlength=len(c))
    keys = mix(c.hashes(starts[full], ends[full]) + doc[full].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, at = np.unique(keys, return_index=True)
    return n, n - np.bincount(doc[full][at], minlength=len(c))


def repeat_words(c: Chunk) -> np.ndarray:
    """Words inside five-word windows that the document holds more than once."""
    w = c.words(NON_SPACE)
    h, at, doc = w.shingles(WINDOW)
    hit = at[repeated(mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))]
    edges = np.zeros(len(w.starts) + 1, dtype=np.int64)
    np.add.at(edges, hit, 1)
    np.add.at(edges, hit + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edges[:-1]) > 0)])
    return np.diff(covered[w.first])


@dataclass(frozen=True)
class Rule:
    """``rejects`` marks the documents of a chunk that break the rule."""

    name: str
    rejects: Callable[[Chunk], np.ndarray]


def symbol_rule(most: float = 0.1) -> Rule:
    return Rule("symbols", lambda c: per_doc_ratio(symbols(c), word_counts(c)) > most)


def duplicate_line_rule(most: float = 0.5) -> Rule:
    def rejects(c: Chunk) -> np.ndarray:
        n, dup = lines(c)
        return per_doc_ratio(dup, n) > most

    return Rule("duplicate_lines", rejects)


def word_length_rule(least: float = 2.0, most: float = 20.0) -> Rule:
    def rejects(c: Chunk) -> np.ndarray:
        mean = per_doc_ratio(word_chars(c), word_counts(c))
        return (mean < least) | (mean > most)

    return Rule("word_length", rejects)


def letter_rule(least: float = 0.5) -> Rule:
    """Words that hold a letter, ASCII or beyond."""
    letter = np.zeros(256, dtype=bool)
    letter[0x41:0x5B] = letter[0x61:0x7B] = letter[0x80:] = True

    def rejects(c: Chunk) -> np.ndarray:
        w = c.words(NON_SPACE)
        seen = np.concatenate([[0], np.cumsum(letter[c.bytes])])
        with_letter = np.concatenate([[0], np.cumsum(seen[w.ends] > seen[w.starts])])
        return per_doc_ratio(np.diff(with_letter[w.first]), w.counts) < least

    return Rule("letters", rejects)


DEFAULT_RULES = (symbol_rule(), duplicate_line_rule(), word_length_rule(), letter_rule())


def run_cascade(c: Chunk, rules: Sequence[Rule], alive: np.ndarray) -> np.ndarray:
    """What is left of ``alive`` after each rule has seen the documents the earlier ones kept."""
    alive = alive.copy()
    for rule in rules:
        rows = np.flatnonzero(alive)
        if not len(rows):
            break
        alive[rows] = ~rule.rejects(c if len(rows) == len(c) else c.take(rows))
    return alive


def ordered(docs: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, sample_docs: int = SAMPLE_DOCS) -> list[Rule]:
    """Rules by rejections per second, highest first, as seen on a sample of about ``sample_docs`` documents.

    One row per rule and task comes back. Ties, and rules that reject nothing, go by cost.
    """

    def timed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column("text")):
                names, seconds, rejected = [], [], []
                for rule in rules:
                    start = time.perf_counter()
                    rejected.append(int(rule.rejects(c).sum()))
                    seconds.append(time.perf_counter() - start)
                    names.append(rule.name)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(seconds), pa.array(rejected)], names=["name", "seconds", "rejected"])

    total = docs.count()  # from file footers
    part = docs.select("text").sample(min(1.0, sample_docs / max(total, 1)), 7)  # spread over all tasks
    seen = part.mapInArrow(timed, "name string, seconds double, rejected long")
    cost = {r["name"]: r for r in seen.groupBy("name").agg(F.sum("seconds").alias("s"), F.sum("rejected").alias("n")).collect()}
    if not cost:
        return list(rules)
    return sorted(rules, key=lambda r: (-cost[r.name]["n"] / max(cost[r.name]["s"], 1e-9), cost[r.name]["s"], r.name))


def judge(docs: DataFrame, rules: Sequence[Rule] | None = None, min_words: int = 10, most_repeats: int = 20) -> DataFrame:
    """(doc_id, the base figures, base_failed, kept) of every document."""
    order = ordered(docs) if rules is None else list(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for c in chunks(batch.column("text")):
                n = word_counts(c)
                repeats = repeat_words(c)
                figures = [n, word_chars(c), symbols(c), lines(c)[1], repeats]
                failed = (n < min_words) | (100 * repeats > most_repeats * n)
                kept = run_cascade(c, order, ~failed)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(c.row, len(c)), *[pa.array(f.astype(np.int64)) for f in figures], pa.array(failed), pa.array(kept)],
                    names=["doc_id", *MEASURES, "base_failed", "kept"],
                )

    schema = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES) + ", base_failed boolean, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
