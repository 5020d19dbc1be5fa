"""Benchmark decontamination with a distributed positional inverted index.

Index: texts are cut into blocks of about ``BLOCK_WORDS`` words, whole documents each. A block's words have
places 0, 1, ... with a gap of ``GAP`` between documents, so that nothing matches across two. The stored
index has one row per (term, block) with the term's ascending places, and one row per block with its documents.

Search: a window is ``window`` consecutive words of a benchmark item, or all words of a shorter one. Terms of
the windows select their posting rows by a Spark join; the rows of a block meet in one task,
bounded by the block. There a window starts from the places of its rarest term over the corpus, shifted to the
window's start, and is intersected with the shifted places of its other terms, rarest first. What is
left are exact matches. Proximity matches ask instead that every term stands within ``slop`` words of a place
of the rarest one, in any order; they are reported beside the exact ones and hit nothing.

Terms are 64-bit hashes of words. Windows are sent to the tasks in slices of about ``SLICE_WINDOWS``, so a
benchmark of any size is searched in several passes over the index. Hits of a slice are written before the next
slice is read, so the driver and the tasks hold one slice at a time. A task looks at ``STARTS`` places of rarest terms
together, so frequent words cost time and not memory.

Null texts and texts without words have no places and are never hit; items without words are ignored. An item without an id hits
and counts as one item, but has no place in the digest of ids. Rows
repeated are judged each by itself, and repeated windows of items count once per item. Empty tables are fine on either side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, remove_path, scratch_path
from .text import ALNUM, chunks, ranges, signed

WINDOW = 10
BLOCK_WORDS = 1 << 19
GAP = 64
SLOP = 20
SLICE_WINDOWS = 1 << 18
#: Places of rarest terms that a task looks at together.
STARTS = 1 << 18
#: Stands for a null item id while searching.
NO_ITEM = -(1 << 63)
INDEX_SCHEMA = "block long, term long, n long, places binary, doc_ids array<long>"


def varint(values: np.ndarray) -> bytes:
    """Non-negative numbers, seven bits a byte, the top bit set on all bytes but a number's last."""
    if not len(values):
        return b""
    v = values.astype(np.uint64)
    size = np.maximum((np.frexp(v.astype(np.float64))[1] + 6) // 7, 1)
    at = np.cumsum(size)
    out = np.zeros(int(at[-1]), dtype=np.uint8)
    first = at - size
    for j in range(int(size.max())):
        has = size > j
        more = (size[has] > j + 1).astype(np.uint8) << 7
        out[first[has] + j] = (v[has] >> np.uint64(7 * j)).astype(np.uint8) & 0x7F | more
    return out.tobytes()


def unvarint(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, dtype=np.uint8)
    if not len(b):
        return np.zeros(0, dtype=np.int64)
    last = np.flatnonzero(b < 0x80)
    first = np.concatenate([[0], last[:-1] + 1])
    shift = np.arange(len(b)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((b & 0x7F).astype(np.int64) << (7 * shift), first)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting rows of the blocks of a task; a block holds whole documents, one at least."""
    block = TaskContext.get().partitionId() << 32
    terms: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    ids: list[pa.Array] = []

    def flush() -> pa.RecordBatch:
        t, n = np.concatenate(terms), np.concatenate(counts)
        starts = np.concatenate([[0], np.cumsum(n + GAP)[:-1]])
        place = ranges(starts, n)
        order = np.argsort(t, kind="stable")
        t, place = t[order], place[order]
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, dtype=np.int64)
        step = np.diff(place, prepend=0)
        step[first] = place[first]
        data, size = _varint_rows(step, first)
        rows = len(first)
        doc_ids = pa.concat_arrays(ids)
        lists = pa.ListArray.from_arrays(pa.array([0] * (rows + 1) + [len(doc_ids)], pa.int32()), doc_ids, mask=pa.array([True] * rows + [False]))
        offsets = np.concatenate([[0], np.cumsum(size)])
        lengths = varint(n)
        places = pa.Array.from_buffers(pa.binary(), rows + 1, [None, pa.py_buffer(np.append(offsets, offsets[-1] + len(lengths)).astype(np.int32)), pa.py_buffer(data + lengths)])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(rows + 1, block)), pa.array(np.append(signed(t[first]), 0), mask=np.append(np.zeros(rows, dtype=bool), True)),
                pa.array(np.append(np.diff(np.append(first, len(t))), len(n))), places, lists,
            ],
            names=["block", "term", "n", "places", "doc_ids"],
        )

    held = 0
    for batch in batches:
        for c in chunks(batch.column("text")):
            w = c.lower().words(ALNUM)
            terms.append(w.hashes())
            counts.append(w.counts)
            ids.append(batch.column("doc_id").slice(c.row, len(c)))
            held += len(w.starts)
            if held >= BLOCK_WORDS:
                yield flush()
                block, held = block + 1, 0
                terms, counts, ids = [], [], []
    if ids:
        yield flush()


def _varint_rows(step: np.ndarray, first: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All steps as varints, and how many bytes each row takes."""
    if not len(step):
        return b"", np.zeros(0, dtype=np.int64)
    size = np.maximum((np.frexp(step.astype(np.float64))[1] + 6) // 7, 1)
    return varint(step), np.add.reduceat(size, first)


def build_index(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Store the postings of ``docs`` (doc_id, text) in ``path``, or with the tables of iterations; rows without a term describe a block's documents."""
    path = path or scratch_path(docs.sparkSession, "postings")
    docs.select("doc_id", "text").mapInArrow(_index, INDEX_SCHEMA).write.parquet(path)
    return docs.sparkSession.read.schema(INDEX_SCHEMA).parquet(path)


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column("text")):
                w = c.lower().words(ALNUM)
                h = signed(w.hashes())
                for d in range(len(c)):
                    own = h[w.first[d] : w.first[d + 1]]
                    if len(own):
                        found = np.unique(np.lib.stride_tricks.sliding_window_view(own, min(window, len(own))), axis=0)
                        item = batch.column("item_id").slice(c.row + d, 1)
                        yield pa.RecordBatch.from_arrays([pa.concat_arrays([item] * len(found)), pa.array(list(found), pa.list_(pa.int64()))], names=["item_id", "terms"])

    return run


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, terms): the distinct windows of each item."""
    items = benchmark.select(F.coalesce("item_id", F.lit(NO_ITEM)).alias("item_id"), "text")
    return items.mapInArrow(_windows(window), "item_id long, terms array<long>").distinct()


class Matcher:
    """Intersects the windows of one slice with the postings of a block."""

    def __init__(self, windows: Sequence[tuple[int, list[int]]], rarity: dict[int, int], slop: int):
        self.items = np.array([w[0] for w in windows], dtype=np.int64)
        self.sizes = np.array([len(w[1]) for w in windows], dtype=np.int64)
        widest = int(self.sizes.max()) if len(self.sizes) else 1
        # Terms of each window, rarest first, with the offset of each in the window; -1 past its end.
        self.terms = np.zeros((len(windows), widest), dtype=np.int64)
        self.offsets = np.full((len(windows), widest), -1, dtype=np.int64)
        for i, (_, terms) in enumerate(windows):
            for j, k in enumerate(sorted(range(len(terms)), key=lambda k: (rarity.get(terms[k], 0), k))):
                self.terms[i, j], self.offsets[i, j] = terms[k], k
        self.slop = slop

    def match(self, terms: np.ndarray, first: np.ndarray, places: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows and start places of exact matches, and windows with a proximity match and its place.

        ``terms`` ascend; the places of term i are ``places[first[i]:first[i + 1]]``.
        """
        if not len(terms) or not len(self.items):
            none = np.zeros(0, dtype=np.int64)
            return none, none, (none, none)
        rows = np.searchsorted(terms, self.terms)
        rows[rows == len(terms)] = 0
        live = np.flatnonzero(((terms[rows] == self.terms) | (self.offsets < 0)).all(axis=1))
        counts = np.diff(first)
        keys = np.repeat(np.arange(len(terms)), counts) * span + places
        # Windows in order, as many at a time as have STARTS places of their rarest term together, one at least.
        total = np.cumsum(counts[rows[live, 0]])
        found = []
        at = 0
        while at < len(live):
            to = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + STARTS, "right")), at + 1)
            found.append(self._intersect(live[at:to], rows, counts, keys, first, places, span))
            at = to
        window, start, near_window, near_at = (np.concatenate(parts) for parts in zip(*found, strict=True)) if found else [np.zeros(0, dtype=np.int64)] * 4
        return window, start, (near_window, near_at)

    def _intersect(self, live, rows, counts, keys, first, places, span) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = counts[rows[live, 0]]
        window = np.repeat(live, n)
        at = places[ranges(first[rows[live, 0]], n)]
        start = at - self.offsets[window, 0]
        exact = start >= 0
        near = np.ones(len(at), dtype=bool)
        for j in range(1, self.terms.shape[1]):
            more = self.offsets[window, j] >= 0
            row = rows[window, j]
            check = np.flatnonzero(more & exact)
            key = row[check] * span + start[check] + self.offsets[window[check], j]
            exact[check] = _holds(keys, key)
            check = np.flatnonzero(more & near)
            low = row[check] * span + np.maximum(at[check] - self.slop, 0)
            to = np.searchsorted(keys, low)
            found = np.where(to < len(keys), keys[np.minimum(to, len(keys) - 1)], -1)
            near[check] = (found >= low) & (found <= row[check] * span + at[check] + self.slop)
            keep = exact | near
            if not keep.all():
                window, at, start, exact, near = window[keep], at[keep], start[keep], exact[keep], near[keep]
        return window[exact], start[exact], window[near], at[near]


def _holds(ordered: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    to = np.searchsorted(ordered, wanted)
    return (to < len(ordered)) & (ordered[np.minimum(to, len(ordered) - 1)] == wanted) if len(ordered) else np.zeros(len(wanted), dtype=bool)


HIT_SCHEMA = "block long, doc int, hits binary, items array<long>, near array<long>"


def _block_hits(shared):
    """Of a block with its documents' row and the postings of wanted terms: hit places and items per document."""

    def run(_, table):
        m: Matcher = shared.value
        is_doc = np.array(table.column("term").is_null())
        about = table.filter(pa.array(is_doc))
        words = unvarint(about.column("places")[0].as_py())
        starts = np.concatenate([[0], np.cumsum(words + GAP)])
        t = table.filter(pa.array(~is_doc))
        terms = np.asarray(t.column("term"), dtype=np.int64)
        order = np.argsort(terms)
        parts = [np.cumsum(unvarint(t.column("places")[int(i)].as_py())) for i in order]
        first = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        places = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
        window, start, (near_window, near_at) = m.match(terms[order], first, places, int(starts[-1]) + GAP)
        doc = np.searchsorted(starts, start, "right") - 1
        near_doc = np.searchsorted(starts, near_at, "right") - 1
        out = []
        for d in np.union1d(doc, near_doc):
            mine = doc == d
            hit = np.zeros(words[d] + 1, dtype=np.int64)
            np.add.at(hit, start[mine] - starts[d], 1)
            np.add.at(hit, start[mine] - starts[d] + m.sizes[window[mine]], -1)
            items = np.unique(m.items[window[mine]])
            covered = np.flatnonzero(np.cumsum(hit[:-1]) > 0)
            out.append((int(d), varint(np.diff(covered, prepend=0)), items, np.setdiff1d(m.items[near_window[near_doc == d]], items)))
        block = table.column("block")[0].as_py()
        d, h, i, n = zip(*out, strict=True) if out else ([], [], [], [])
        return pa.table(
            {"block": pa.array([block] * len(out), pa.int64()), "doc": pa.array(d, pa.int32()), "hits": pa.array(h, pa.binary()),
             "items": pa.array(i, pa.list_(pa.int64())), "near": pa.array(n, pa.list_(pa.int64()))}
        )

    return run


def search(index: DataFrame, windows: DataFrame, slop: int = SLOP) -> DataFrame:
    """(block, doc, hits, items, near) of every document with a match, from the stored postings."""
    spark = index.sparkSession
    windows = materialize(windows, "windows")
    wanted = windows.select(F.explode("terms").alias("term")).distinct()
    total = windows.count()
    # Rarity of the searched terms only; as many rows as the benchmark has distinct words.
    counts = index.where("term is not null").join(wanted, "term").groupBy("term").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "rarity")
    slices = max(1, -(-total // SLICE_WINDOWS))
    found = None
    for i in range(slices):
        part = windows.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(slices)) == i)
        rows = [(r["item_id"], r["terms"]) for r in part.toLocalIterator()]
        own = part.select(F.explode("terms").alias("term")).distinct()
        rarity = {r["term"]: r["n"] for r in counts.join(own, "term", "left_semi").toLocalIterator()}
        shared = spark.sparkContext.broadcast(Matcher(rows, rarity, slop))
        postings = index.where("term is not null").join(own, "term", "left_semi").select("block", "term", "n", "places")
        blocks = index.where("term is null").select("block", "term", "n", "places")
        hits = materialize(postings.unionByName(blocks).groupBy("block").applyInArrow(_block_hits(shared), HIT_SCHEMA), "hits")
        shared.destroy()
        found = hits if found is None else found.unionByName(hits)
    return found


def _document_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            words = unvarint(batch.column("places")[i].as_py())
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column("block")[i].as_py()] * len(words), pa.int64()), pa.array(np.arange(len(words), dtype=np.int32)),
                 batch.column("doc_ids")[i].values, pa.array(words)],
                names=["block", "doc", "doc_id", "n_words"],
            )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        hit = [sum(len(x) for x in parts) if len(parts) == 1 else len(np.unique(np.concatenate(parts))) if parts else 0
               for parts in ([np.cumsum(unvarint(h)) for h in r["hits"] or []] for r in rows)]
        items = [sorted({str(i) for part in r["items"] or [] for i in part if i != NO_ITEM}) for r in rows]
        exact = [{i for part in r["items"] or [] for i in part} for r in rows]
        near = [len({i for part in r["near"] or [] for i in part} - e) for r, e in zip(rows, exact, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array([len(e) for e in exact], pa.int64()),
             pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items]), pa.array([h > 0 for h in hit]), pa.array(near, pa.int64())],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near_items"],
        )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items) of every row of ``docs``."""
    path = scratch_path(docs.sparkSession, "postings")
    index = build_index(docs, path)
    found = search(index, benchmark_windows(benchmark, window), slop)
    per_doc = found.groupBy("block", "doc").agg(F.collect_list("hits").alias("hits"), F.collect_list("items").alias("items"), F.collect_list("near").alias("near"))
    rows = index.where("term is null").select("block", "places", "doc_ids").mapInArrow(_document_rows, "block long, doc int, doc_id long, n_words long")
    rows = materialize(rows, "document-words")  # read again, a task needs one Python worker and not two, each of which stays
    remove_path(docs.sparkSession, path)  # hits and words are stored, nothing reads the postings any more
    joined = rows.join(per_doc, ["block", "doc"], "left").select("doc_id", "n_words", "hits", "items", "near")
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near_items long"
    return joined.mapInArrow(_digest, schema)
