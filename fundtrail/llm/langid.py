"""Language of whole texts, by the languages of their words.

Training counts byte trigrams of the words of labelled texts by language, over a bounded sample: the
``max_docs`` texts of each language with the smallest id hashes. A word's score under a language is the sum
of its trigrams' log probabilities. Script ranges narrow the candidates first: a language only competes for
words of scripts that it uses in training. Viterbi over the words of a text, with a penalty for every
switch, then labels spans, so that single odd words don't break a span and mixed texts keep theirs.
The text's language is the one whose spans hold the most bytes of words with letters; score is its share.

A text that is null, empty or without a letter gets ``und`` and score 0, as does every text when nothing
could be learned. Ties go to the first language by name. Repeated rows get equal results, and an empty table an
empty one. Rows with null language are not learned from. Very long texts are labelled whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import ALNUM, Chunk, Words, chunks

BUCKETS = 1 << 16
MAX_DOCS = 1500
MAX_LANGUAGES = 400
#: Scores, a word and language each, that a task labels together.
CELLS = 1 << 22
SWITCH = 12.0
SMOOTH = 0.3
OUTSIDE = -40.0
UNKNOWN = "und"

#: Script of a word, by the first byte of its characters' UTF-8 forms: fixed values from Unicode's block ranges.
SCRIPTS = ("none", "latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "kana", "han", "hangul", "other")
_LEADS = {1: [(0x41, 0x5A), (0x61, 0x7A), (0xC3, 0xC9)], 2: [(0xCD, 0xCF)], 3: [(0xD0, 0xD4)], 4: [(0xD6, 0xD7)], 5: [(0xD8, 0xDB)],
          6: [(0xE0, 0xE0)], 7: [(0xE3, 0xE3)], 8: [(0xE4, 0xE9)], 9: [(0xEA, 0xED)], 10: [(0xCA, 0xCC), (0xD5, 0xD5), (0xDC, 0xDF), (0xE1, 0xE2), (0xEE, 0xF4)]}
LONE_LETTERS = (0xAA, 0xB5, 0xBA)  # after lead byte 0xC2
SCRIPT_OF = np.zeros(256, dtype=np.uint8)
for _script, _ranges in _LEADS.items():
    for _a, _b in _ranges:
        SCRIPT_OF[_a : _b + 1] = _script


@dataclass
class Model:
    """Log probability of each trigram bucket and use of each script, by language: a few MB at most."""

    languages: list[str]
    logp: np.ndarray  # languages x BUCKETS
    uses: np.ndarray  # languages x scripts


def trigrams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte trigrams of the words, a space led and trailed, and each word's first one."""
    sizes = w.ends - w.starts
    first = np.concatenate([[0], np.cumsum(sizes)])
    b = w.chunk.bytes.astype(np.uint32)
    inside = np.repeat(w.starts - first[:-1], sizes) + np.arange(first[-1])
    mid = b[inside]
    left, right = np.empty_like(mid), np.empty_like(mid)
    left[1:], right[:-1] = mid[:-1], mid[1:]
    left[first[:-1]], right[first[1:] - 1] = 0x20, 0x20
    h = (left << 16 | mid << 8 | right) * np.uint32(2654435761)
    return (h >> np.uint32(16)).astype(np.int64), first


def scripts(w: Words) -> np.ndarray:
    """The furthest script from Latin among a word's characters; 0 without a letter."""
    if not len(w.starts):
        return np.zeros(0, dtype=np.uint8)
    cuts = np.empty(2 * len(w.starts), dtype=np.int64)
    cuts[0::2], cuts[1::2] = w.starts, w.ends
    padded = np.append(SCRIPT_OF[w.chunk.bytes], np.uint8(0))
    # Letters among the signs that share their lead byte: feminine and masculine ordinal, micro.
    lead = np.flatnonzero(w.chunk.bytes[:-1] == 0xC2)
    padded[lead[np.isin(w.chunk.bytes[lead + 1], LONE_LETTERS)]] = 1
    return np.maximum.reduceat(padded, cuts)[0::2]


def emissions(w: Words, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Score of every word under every language, and which words have a letter."""
    bucket, first = trigrams(w)
    script = scripts(w)
    out = np.zeros((len(w.starts), len(model.languages)), dtype=np.float32)
    candidates = model.uses[:, script]
    nowhere = ~candidates.any(axis=0)
    for k in range(len(model.languages)):
        if len(w.starts):
            out[:, k] = np.add.reduceat(model.logp[k][bucket], first[:-1])
            out[~(candidates[k] | nowhere), k] += OUTSIDE
    lettered = script > 0
    out[~lettered] = 0
    return out, lettered


def viterbi(counts: np.ndarray, scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of every word of documents with so many words each; they advance together, the longest to its end."""
    n, k = scores.shape
    path = np.zeros(n, dtype=np.int64)
    docs = np.argsort(-counts, kind="stable")
    at, counts = (np.cumsum(counts) - counts)[docs], counts[docs]
    longest = int(counts[0]) if len(counts) else 0
    if not longest:
        return path
    active = np.searchsorted(-counts, -np.arange(longest), "left")  # documents with more than t words
    came = np.empty((n, k), dtype=np.uint8 if k < 256 else np.uint16)
    own = np.arange(k, dtype=came.dtype)
    v = scores[at[: active[0]]].copy()
    for t in range(1, longest):
        a = active[t]
        here = at[:a] + t
        v = v[:a]
        best = v.argmax(axis=1)
        jump = (v[np.arange(a), best] - switch)[:, None]
        moved = jump > v
        came[here] = np.where(moved, best[:, None].astype(came.dtype), own)
        lead = np.maximum(v, jump)
        v_new = lead + scores[here]
        if t + 1 < longest and active[t + 1] < a or t + 1 == longest:
            ended = slice(active[t + 1] if t + 1 < longest else 0, a)
            path[here[ended]] = v_new[ended].argmax(axis=1)
        v = v_new
    ones = slice(active[1] if longest > 1 else 0, active[0])
    path[at[ones]] = scores[at[ones]].argmax(axis=1)
    for t in range(longest - 1, 0, -1):
        here = at[: active[t]] + t
        path[here - 1] = came[here, path[here]]
    return path


def learnable(doc_id: Column, language: Column) -> Column:
    """Rows to learn from: a language, and an id outside the fold that is held out."""
    return language.isNotNull() & ~held_out(doc_id)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """Fit on at most ``max_docs`` texts of each language of ``docs`` (doc_id, text, lang).

    The ids are chosen first, by a limit per language that applies ahead of the exchange; then the chosen
    texts are counted in eight tasks, which send one table of fixed size per language each.
    """
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    order = Window.partitionBy("lang").orderBy("h")
    ids = rows.select("lang", F.xxhash64("doc_id").alias("h"))
    last = ids.withColumn("r", F.row_number().over(order)).where(F.col("r") <= max_docs).groupBy("lang").agg(F.max("h").alias("last")).collect()
    if len(last) > MAX_LANGUAGES:
        raise ValueError(f"{len(last)} languages; at most {MAX_LANGUAGES} are supported")
    if not last:
        return Model([], np.zeros((0, BUCKETS), dtype=np.float32), np.zeros((0, len(SCRIPTS)), dtype=bool))
    cut = F.create_map(*[x for r in last for x in (F.lit(r["lang"]), F.lit(r["last"]))])
    chosen = rows.where(F.xxhash64("doc_id") <= F.element_at(cut, F.col("lang"))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        used: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for c in chunks(batch.column("text")):
                w = c.lower().words(ALNUM)
                bucket, first = trigrams(w)
                script = scripts(w)
                sizes = np.diff(first)
                doc = w.doc()
                for lang in np.unique(langs[c.row : c.row + len(c)].astype(str)):
                    mine = (langs[c.row : c.row + len(c)] == lang)[doc]
                    letters = mine & (script > 0)
                    grams[lang] = grams.get(lang, 0) + np.bincount(bucket[np.repeat(letters, sizes)], minlength=BUCKETS)
                    used[lang] = used.get(lang, 0) + np.bincount(script[letters], minlength=len(SCRIPTS))
        if grams:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(grams)), pa.array([g.astype("<i8").tobytes() for g in grams.values()]), pa.array([u.astype("<i8").tobytes() for u in used.values()])],
                names=["lang", "grams", "used"],
            )

    languages = sorted(r["lang"] for r in last)
    grams, used = np.zeros((len(languages), BUCKETS)), np.zeros((len(languages), len(SCRIPTS)))
    for r in chosen.repartition(8).mapInArrow(count, "lang string, grams binary, used binary").toLocalIterator():
        k = languages.index(r["lang"])
        grams[k] += np.frombuffer(r["grams"], dtype="<i8")
        used[k] += np.frombuffer(r["used"], dtype="<i8")
    logp = np.log((grams + SMOOTH) / (grams.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS))
    return Model(languages, logp.astype(np.float32), used > 0.01 * used.sum(axis=1, keepdims=True))


def scored_words(texts: pa.Array, model: Model) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first document, words of each document, scores of all words, bytes of each word with a letter or 0), about CELLS scores at a time."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    cells = row = begun = 0
    for c in chunks(texts):
        w = c.lower().words(ALNUM)
        scores, lettered = emissions(w, model)
        held.append((w.counts, scores, np.where(lettered, w.ends - w.starts, 0)))
        cells, row = cells + scores.size, row + len(c)
        if cells >= CELLS or row == len(texts):
            counts, scores, weight = (np.concatenate(part) for part in zip(*held, strict=True))
            yield begun, counts, scores, weight
            held, cells, begun = [], 0, row


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(row, lang_pred, score, n_spans): every row of ``docs`` as a struct, whatever its columns, with its language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    schema = rows.select("row").schema.add("lang_pred", "string").add("score", "double").add("n_spans", "long")
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names, k = np.array([*m.languages, UNKNOWN], dtype=object), len(m.languages)
        for batch in batches:
            letter = batch.column("letter").to_numpy(zero_copy_only=False).astype(bool)
            pred, score, spans = np.full(len(letter), k), np.zeros(len(letter)), np.zeros(len(letter), dtype=np.int64)
            for begun, counts, scores, weight in scored_words(batch.column("row").field(text), m) if k else ():
                path = viterbi(counts, scores)
                n, doc = len(counts), np.repeat(np.arange(len(counts)), counts)
                share = np.bincount(doc * k + path, weights=weight, minlength=n * k).reshape(-1, k)
                total = share.sum(axis=1)
                own = slice(begun, begun + n)
                known = letter[own] & (total > 0)
                pred[own][known] = share[known].argmax(axis=1)
                score[own][known] = share[known].max(axis=1) / total[known]
                change = np.ones(len(path), dtype=bool)
                change[1:] = (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])
                spans[own] = np.where(known, np.bincount(doc[change], minlength=n), 0)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(names[pred], pa.string()), pa.array(score), pa.array(spans)], names=["row", "lang_pred", "score", "n_spans"])

    return rows.mapInArrow(run, schema)


def predict(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_spans): learn outside the held-out fold, predict every row."""
    model = train(docs.where(learnable(F.col("doc_id"), F.col("lang"))), max_docs)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score", "n_spans")
