"""Quality of whole texts by attention-based multiple-instance learning.

A text is a bag of passages of about PASSAGE_WORDS words, cut evenly, and only the bag has a label. Every passage of the whole
text is encoded: shares of byte classes, form and repetition of its words, and signed hashes of the words, through a learned layer. A
gated attention (a tanh branch times a sigmoid branch) weighs the passages of a bag against each other, and the weighted sum of
their encodings is scored by a logistic unit. Encoder, attention and unit are learned together from document labels by gradient
descent (Adam). What draws the attention is told with each score: the passage of the highest weight, as a span of words.

Learning takes a bounded sample: about ``max_docs`` labelled documents, chosen by a hash of doc_id, and of each at most ``max_bag``
passages at even distances. Scoring takes all passages of all documents, in tasks, without a shuffle.

Results: a null or empty text is one empty passage and gets a score like any other. Rows without a usable label are not learned
from; several labels of an id are averaged, and of several texts of an id the last in byte order is learned from. Without any label
every score is 0.5. Repeated rows get equal scores (rounded to 12 digits, so that what
shares a task with them doesn't show), an empty table an empty result. Columns other than doc_id and text are handed
through as they are, whatever their names. Very long texts are encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .text import NON_SPACE, U64, Chunk, chunks, mix, ranges

PASSAGE_WORDS = 48
MAX_DOCS = 3000
MAX_BAG = 32
HIDDEN, GATE, BUCKETS = 24, 12, 128
EPOCHS, STEP, BAGS, DECAY = 30, 0.004, 32, 1e-4
SHINGLE = 3

#: Class of a byte: letters, digits, white space, bytes beyond ASCII, and every ASCII sign by itself.
SIGNS = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
CLASSES = 7 + len(SIGNS)
CLASS_OF = np.full(256, 6, dtype=np.int64)
CLASS_OF[0x41:0x5B], CLASS_OF[0x61:0x7B], CLASS_OF[0x30:0x3A], CLASS_OF[0x20], CLASS_OF[0x0A], CLASS_OF[0x80:] = 0, 1, 2, 3, 4, 5
CLASS_OF[SIGNS] = 7 + np.arange(len(SIGNS))
FORMS = 7
FEATURES = CLASSES + FORMS + BUCKETS


def passages(counts: np.ndarray, size: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """How many passages each document has, at least one, and the first word of each passage within its document."""
    n = np.maximum((counts + size // 2) // size, 1)
    nth = ranges(np.zeros(len(n), dtype=np.int64), n)
    return n, -(-nth * np.repeat(counts, n) // np.repeat(n, n))


def encode(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of every passage of a chunk, passages per document, first word of each passage, words per document."""
    w = c.words(NON_SPACE)
    n, first = passages(w.counts)
    doc = np.repeat(np.arange(len(c)), n)
    word = w.first[:-1][doc] + first  # first word of each passage; beyond the last one where a document has none
    start = np.append(w.starts, len(c.bytes))[word]
    opening = np.concatenate([[0], np.cumsum(n)[:-1]])
    start[opening] = c.offsets[:-1]
    bounds = np.append(start, len(c.bytes))
    total = len(doc)
    sizes = np.diff(bounds)
    by_class = np.bincount(np.repeat(np.arange(total) * CLASSES, sizes) + CLASS_OF[c.bytes], minlength=total * CLASSES).reshape(total, CLASSES)
    out = np.zeros((total, FEATURES), dtype=np.float32)
    out[:, :CLASSES] = np.sqrt(by_class / np.maximum(sizes, 1)[:, None])

    in_passage = np.diff(np.append(word, len(w.starts)))
    of = np.repeat(np.arange(total), in_passage)
    some = np.maximum(in_passage, 1)
    share = lambda flags: np.bincount(of, weights=flags, minlength=total) / some
    kinds = np.concatenate([[0], np.cumsum(CLASS_OF[c.bytes] == 0)]), np.concatenate([[0], np.cumsum(CLASS_OF[c.bytes] == 1)])
    upper, lower = (k[w.ends] - k[w.starts] for k in kinds)
    hashes = c.lower().hashes(w.starts, w.ends) if len(w.starts) else np.zeros(0, dtype=U64)
    once = np.zeros(len(of), dtype=bool)
    once[np.unique(mix(hashes ^ mix(of.astype(U64))), return_index=True)[1]] = True
    again = np.zeros(len(of) + 1, dtype=np.int64)
    run, at, owner = w.shingles(SHINGLE, hashes)
    _, back, often = np.unique(mix(run ^ mix(owner.astype(U64))), return_inverse=True, return_counts=True)
    twice = at[often[back] > 1] if len(at) else at
    for j in range(SHINGLE):
        again[twice + j] = 1
    forms = [
        np.log1p(in_passage) / 4, np.log1p(np.repeat(w.counts, n)) / 8, share((w.ends - w.starts) / 10.0), share((upper > 1) & (lower == 0)),
        share(upper + lower == 0), share(once), share(again[:-1]),
    ]
    for j, values in enumerate(forms):
        out[:, CLASSES + j] = values
    bucket = (hashes & U64(BUCKETS - 1)).astype(np.int64)
    sign = np.where(hashes >> U64(40) & U64(1), 1.0, -1.0)
    out[:, CLASSES + FORMS :] = np.bincount(of * BUCKETS + bucket, weights=sign, minlength=total * BUCKETS).reshape(total, BUCKETS) / np.sqrt(some)[:, None]
    return out, n, first, w.counts


@dataclass
class Model:
    """Scaling of the features and weights of encoder, attention and unit; None where nothing could be learned."""

    shift: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray] | None


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def forward(x: np.ndarray, n: np.ndarray, p: dict[str, np.ndarray]):
    """Scores of bags, attention of passages and what backward() needs; bag b has the next n[b] passages."""
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    bag = np.repeat(np.arange(len(n)), n)
    h = np.tanh(x @ p["encode"] + p["encode_bias"])
    t, g = np.tanh(h @ p["tanh"]), _sigmoid(h @ p["gate"])
    e = (t * g) @ p["attend"]
    e = np.exp(e - np.maximum.reduceat(e, first)[bag])
    a = e / np.add.reduceat(e, first)[bag]
    z = np.add.reduceat(a[:, None] * h, first, axis=0)
    score = _sigmoid(z @ p["unit"] + p["bias"][0])
    return score, a, (first, bag, h, t, g, z)


def backward(x: np.ndarray, y: np.ndarray, score: np.ndarray, a: np.ndarray, kept, p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Gradients of the mean logistic loss."""
    first, bag, h, t, g, z = kept
    d = (score - y) / len(y)
    dz = d[:, None] * p["unit"]
    da = (dz[bag] * h).sum(axis=1)
    de = a * (da - np.add.reduceat(a * da, first)[bag])
    dtg = de[:, None] * p["attend"]
    dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
    dh = a[:, None] * dz[bag] + dt @ p["tanh"].T + dg @ p["gate"].T
    dpre = dh * (1 - h * h)
    return {
        "encode": x.T @ dpre, "encode_bias": dpre.sum(axis=0), "tanh": h.T @ dt, "gate": h.T @ dg,
        "attend": (t * g).T @ de, "unit": z.T @ d, "bias": np.array([d.sum()]),
    }


def fit(bags: list[np.ndarray], y: np.ndarray, seed: int = 7) -> Model:
    """Fit on bags of passage features and a label from 0 to 1 for each bag."""
    if not bags:
        return Model(np.zeros(FEATURES), np.ones(FEATURES), None)
    every = np.concatenate(bags).astype(np.float64)
    shift, scale = every.mean(axis=0), every.std(axis=0) + 0.05
    bags = [(b - shift) / scale for b in bags]
    rng = np.random.default_rng(seed)
    size = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    p = {
        "encode": size(FEATURES, HIDDEN), "encode_bias": np.zeros(HIDDEN), "tanh": size(HIDDEN, GATE), "gate": size(HIDDEN, GATE),
        "attend": size(GATE), "unit": size(HIDDEN), "bias": np.array([np.log((y.mean() + 0.01) / (1.01 - y.mean()))]),
    }
    m, v, step = {k: np.zeros_like(w) for k, w in p.items()}, {k: np.zeros_like(w) for k, w in p.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        rate = STEP * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
        for at in range(0, len(order), BAGS):
            mine = order[at : at + BAGS]
            x, n = np.concatenate([bags[i] for i in mine]), np.array([len(bags[i]) for i in mine])
            score, a, kept = forward(x, n, p)
            step += 1
            for k, grad in backward(x, y[mine], score, a, kept, p).items():
                grad = grad + DECAY * p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(shift, scale, p)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_bag: int = MAX_BAG) -> Model:
    """Fit on about ``max_docs`` labelled documents: ``docs`` (doc_id, text), ``labels`` (doc_id, label from 0 to 1)."""
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.avg("label").alias("label"))
    total = known.count()
    wanted = known
    if total > max_docs:  # a hash is below the bound in max_docs of total cases
        wanted = known.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < (max_docs << 30) // total)
    texts = docs.select("doc_id", "text").join(wanted, "doc_id").groupBy("doc_id", "label").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column("text")):
                x, n, _, _ = encode(c)
                first = np.concatenate([[0], np.cumsum(n)])
                out = []
                for i in range(len(c)):
                    pick = np.unique(np.linspace(first[i], first[i + 1] - 1, min(int(n[i]), max_bag)).astype(np.int64))
                    out.append(x[pick].astype("<f4").tobytes())
                here = slice(c.row, c.row + len(c))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[here], batch.column("label")[here], pa.array(out, pa.binary())], names=["doc_id", "label", "bag"])

    schema = texts.select("doc_id", "label").schema.add("bag", "binary")
    rows = sorted(texts.mapInArrow(run, schema).collect(), key=lambda r: r["doc_id"])
    bags = [np.frombuffer(r["bag"], dtype="<f4").reshape(-1, FEATURES) for r in rows]
    return fit(bags, np.array([r["label"] for r in rows], dtype=np.float64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(row, score, n_passages, top_start, top_end, top_weight): every row of ``docs`` as a struct, whatever its columns.

    Words ``top_start`` up to ``top_end`` are the passage with the highest attention, ``top_weight`` its share.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text"))
    names = ["score", "n_passages", "top_start", "top_end", "top_weight"]
    schema = rows.select("row").schema.add("score", "double").add("n_passages", "long").add("top_start", "long").add("top_end", "long").add("top_weight", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for c in chunks(batch.column("text")):
                x, n, first, counts = encode(c)
                if m.weights is None:
                    good, a = np.full(len(c), 0.5), np.repeat(1.0 / n, n)
                else:
                    good, a, _ = forward((x - m.shift) / m.scale, n, m.weights)
                begin = np.concatenate([[0], np.cumsum(n)[:-1]])
                top = np.lexsort((-a, np.repeat(np.arange(len(c)), n)))[begin]
                after = np.append(first[1:], 0)[top]
                last = top == begin + n - 1
                found = [np.round(good, 12), n, first[top], np.where(last, counts, after), a[top]]
                row = batch.column("row").slice(c.row, len(c))
                yield pa.RecordBatch.from_arrays([row, *[pa.array(f) for f in found]], names=["row", *names])

    return spread(rows).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(doc_id, held_out, score, predicted, ...): learn outside the held-out fold, score every row."""
    ids = labels.where(~held_out(F.col("doc_id")))
    model = train(docs, ids, max_docs)
    found = score(docs.select("doc_id", "text"), model)
    return found.select(
        "row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages", "top_start", "top_end", "top_weight"
    )
