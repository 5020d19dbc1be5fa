"""Ranked lexical search over K2-treaps of the term-document grid.

Documents are dealt into blocks where they are read, without a shuffle of texts. A block is a grid with a row per term, a
column per document and in each cell the term's impact in the document: its saturated, length-normalised frequency. The grid
is kept as a quadtree in level order. A cell of the tree has four bits for its non-empty quarters and the largest
impact inside, stored as the difference to the cell above; a cell with a single entry ends its branch there, so that long
paths to lone entries take no room. Arrays are compressed with zstandard. One Parquet row holds one block.

A query walks the paths of its terms' rows together. Its state is a range of documents with one cell for each term; its bound
is the sum of term weights times the cells' maxima. The best states are opened first, in batches: a state splits into the two
halves of its documents. States below the score of the k-th best document so far go, and that score passes from block to block
of a task. The best k of all tasks are the answer, exactly.

Weights follow from document counts over the whole index: rows of all blocks meet the queries' terms in one join and one sum.
Queries are worked off in slices of about SLICE_PAIRS (query, term) pairs, chosen by hash: a slice is broadcast, its hits are
written, and it is dropped before the next one, so memory does not grow with the number of queries.

Results: a null or empty text has no terms; it is no document of the statistics and is never found. Queries without terms, or whose
terms no document holds, have no rows. Every row of the documents and of the queries counts on its own, whether or not its id repeats;
equal scores go by ascending doc_id, null last, and then by place in the scan. Terms are compared by 64-bit hashes. A very long text
is one column of a block of its own size. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, spread
from .text import ALNUM, Chunk, chunks, signed

BLOCK_WORDS = 1 << 20
BLOCK_BYTES = 8 << 20
SLICE_PAIRS = 1 << 17
BATCH = 512
K = 50
#: Fixed values of the score: impact scale, saturation, length share in percent, weight scale.
SCALE, TF, SATURATION, LENGTH, WEIGHT = 1_000_000_000, 1000, 20, 50, 1000

INDEX = "block long, docs array<long>, known array<boolean>, terms array<long>, dfs array<int>, shape array<int>, bits binary, maxima binary, rows binary, columns binary"


@dataclass(frozen=True)
class Index:
    blocks: DataFrame
    n_docs: int
    n_terms: int


def pack(a: np.ndarray, dtype: str) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a, dtype=dtype).tobytes())


def unpack(data: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=dtype)


def _bits(n: int) -> int:
    return max(int(n) - 1, 0).bit_length()


def _interleave(rows: np.ndarray, columns: np.ndarray, height: int) -> np.ndarray:
    code = np.zeros(len(rows), dtype=np.uint64)
    r, c = rows.astype(np.uint64), columns.astype(np.uint64)
    for i in range(height):
        i = np.uint64(i)
        one = np.uint64(1)
        code |= ((c >> i) & one) << (i + i)
        code |= ((r >> i) & one) << (i + i + one)
    return code


def build_tree(rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray, height: int):
    """(bits, maxima, leaf rows, leaf columns) of the entries, cells in level order.

    Every entry ends in one leaf: the first cell that it has for itself. Leaves have no bits; their rows and columns are listed in
    the order in which they come among the cells.
    """
    order = np.argsort(_interleave(rows, columns, height), kind="stable")
    rows, columns, impacts = rows[order], columns[order], impacts[order].astype(np.int64)
    code = _interleave(rows, columns, height)
    bits, maxima, leaf_rows, leaf_columns = [], [], [], []
    above = None  # maximum of the cell above, per entry
    for level in range(height + 1):
        if not len(code):
            break
        prefix = code >> np.uint64(2 * (height - level))
        fresh = np.ones(len(code), dtype=bool)
        fresh[1:] = prefix[1:] != prefix[:-1]
        first = np.flatnonzero(fresh)
        size = np.diff(np.append(first, len(code)))
        top = np.maximum.reduceat(impacts, first)
        maxima.append(top if above is None else above[first] - top)
        lone = size == 1
        quarter = np.zeros(len(first), dtype=np.uint8)
        if level < height:
            below = (code >> np.uint64(2 * (height - level - 1))) & np.uint64(3)
            quarter = np.bitwise_or.reduceat(np.left_shift(1, below.astype(np.uint8)).astype(np.uint8), first)
            quarter[lone] = 0
        bits.append(quarter)
        ends = first[lone] if level < height else first
        leaf_rows.append(rows[ends])
        leaf_columns.append(columns[ends])
        stay = np.repeat(~lone & (level < height), size)
        above = np.repeat(top, size)[stay]
        code, rows, columns, impacts = code[stay], rows[stay], columns[stay], impacts[stay]
    join = lambda parts, dtype: np.concatenate(parts).astype(dtype) if parts else np.zeros(0, dtype)
    return join(bits, np.uint8), join(maxima, np.int32), join(leaf_rows, np.int32), join(leaf_columns, np.int32)


class Treap:
    """A block's tree ready to walk: quarters by number, maxima summed down from the root, coordinates of leaves."""

    def __init__(self, terms, shape, bits, maxima, rows, columns):
        self.terms = terms
        self.height = int(shape[0])
        bits, differences = unpack(bits, "u1"), unpack(maxima, "<i4")
        n = len(bits)
        has = (bits[:, None] >> np.arange(4, dtype=np.uint8)) & 1
        self.child = np.where(has == 1, np.cumsum(has.ravel()).reshape(n, 4), -1).astype(np.int32)
        self.best = np.zeros(n + 1, dtype=np.int64)  # the last one stands for "no cell"
        self.best[:n] = differences
        start, end = 0, min(1, n)
        while end < n:  # a level's cells lie together, the next level's follow
            kids = self.child[start:end]
            parents = np.repeat(np.arange(start, end), (kids >= 0).sum(axis=1))
            start, end = end, end + len(parents)
            self.best[start:end] = self.best[parents] - self.best[start:end]
        leaf = bits == 0
        self.row = np.full(n + 1, -1, dtype=np.int32)
        self.column = np.full(n + 1, -1, dtype=np.int32)
        self.row[:n][leaf], self.column[:n][leaf] = unpack(rows, "<i4"), unpack(columns, "<i4")

    def search(self, rows: np.ndarray, weights: np.ndarray, floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Columns and scores of the documents that can be among the best k; ``floor`` is a score known to be reached k times.

        Batches of the best states of one level are opened at a time. What is only made of leaves is settled at once.
        """
        height, best = self.height, self.best
        found_c, found_s = [], []
        pools: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(height + 2)]
        heap: list[tuple[int, int]] = []
        n_best = np.zeros(0, dtype=np.int64)

        def settle(columns: np.ndarray, scores: np.ndarray) -> None:
            nonlocal n_best, floor
            keep = scores > 0
            found_c.append(columns[keep])
            found_s.append(scores[keep])
            n_best = np.concatenate([n_best, scores[keep]])
            if len(n_best) > k:
                n_best = np.partition(n_best, len(n_best) - k)[-k:]
            if len(n_best) == k:
                floor = max(floor, int(n_best.min()))

        def offer(level: int, prefix: np.ndarray, cells: np.ndarray) -> None:
            bound = best[cells] @ weights
            keep = (bound > 0) & (bound >= floor)
            prefix, cells, bound = prefix[keep], cells[keep], bound[keep]
            if not len(prefix):
                return
            done = (self.row[cells] >= 0) | (cells < 0)
            whole = done.all(axis=1)
            if whole.any():
                state, term = np.nonzero(cells[whole] >= 0)
                at = cells[whole][state, term]
                column, back = np.unique(self.column[at], return_inverse=True)
                score = np.zeros(len(column), dtype=np.int64)
                np.add.at(score, back, best[at] * weights[term])
                settle(column, score)
                prefix, cells, bound = prefix[~whole], cells[~whole], bound[~whole]
            if len(prefix):
                pools[level].append((bound, prefix, cells))
                heapq.heappush(heap, (-int(bound.max()), level))

        offer(0, np.zeros(1, dtype=np.int64), self._own(np.zeros((1, len(rows)), dtype=np.int32), rows))
        while heap:
            top, level = heapq.heappop(heap)
            if -top < floor:
                break
            if not pools[level]:
                continue
            bound, prefix, cells = (np.concatenate(x) for x in zip(*pools[level]))
            pools[level] = []
            if len(bound) > BATCH:
                order = np.argsort(-bound, kind="stable")
                rest = order[BATCH:]
                rest = rest[bound[rest] >= floor]
                if len(rest):
                    pools[level].append((bound[rest], prefix[rest], cells[rest]))
                    heapq.heappush(heap, (-int(bound[rest[0]]), level))
                prefix, cells = prefix[order[:BATCH]], cells[order[:BATCH]]
            shift = height - level - 1
            quarter = (rows >> shift & 1) * 2
            ends = self.row[cells] >= 0
            inside = self.column[cells] >> shift
            for half in (0, 1):
                down = np.where(cells >= 0, self.child[cells, quarter + half], -1)
                ahead = prefix * 2 + half
                down = np.where(ends, np.where(inside == ahead[:, None], cells, -1), down)
                offer(level + 1, ahead, self._own(down, rows))
        none = np.zeros(0, dtype=np.int64)
        return (np.concatenate(found_c), np.concatenate(found_s)) if found_c else (none, none)

    def _own(self, cells: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Leaves that belong to another row are no cells of this one."""
        other = self.row[cells]
        return np.where((other >= 0) & (other != rows), -1, cells)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = words = 0
    for batch in batches:
        for c in chunks(batch.column("text")):
            counts = c.lower().words(ALNUM).counts
            docs, words = docs + int((counts > 0).sum()), words + int(counts.sum())
    yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([words], pa.int64())], names=["docs", "words"])


def impact(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    if len(n) and int(n.max()) * LENGTH * n_docs > 2**62:
        share = np.array([int(x) * LENGTH * n_docs // n_terms for x in n], dtype=np.int64)
    else:
        share = (LENGTH * n.astype(np.int64) * n_docs) // max(n_terms, 1)
    return (SCALE * tf) // (TF * tf + SATURATION * (100 - LENGTH + share))


def _block(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], n_docs: int, n_terms: int, number: int) -> dict:
    """A block of documents, given as (ids, known, word counts, word hashes); longer ones are put together."""
    ids, known, counts = (np.concatenate([p[i] for p in parts]) for i in range(3))
    hashes = np.concatenate([p[3] for p in parts])
    terms, row = np.unique(hashes, return_inverse=True)
    by_length = np.argsort(counts, kind="stable")
    column_of = np.empty(len(ids), dtype=np.int64)
    column_of[by_length] = np.arange(len(ids))
    cell, tf = np.unique(row * len(ids) + np.repeat(column_of, counts), return_counts=True)
    row, column = cell // len(ids), cell % len(ids)
    value = impact(tf.astype(np.int64), counts[by_length][column], n_docs, n_terms)
    height = max(_bits(len(terms)), _bits(len(ids)))
    bits, maxima, leaf_rows, leaf_columns = build_tree(row, column, value, height)
    return {
        "block": number, "docs": ids[by_length], "known": known[by_length], "terms": signed(terms), "dfs": np.bincount(row, minlength=len(terms)).astype(np.int32),
        "shape": np.array([height], dtype=np.int32), "bits": pack(bits, "u1"), "maxima": pack(maxima, "<i4"), "rows": pack(leaf_rows, "<i4"), "columns": pack(leaf_columns, "<i4"),
    }


def build_index(docs: DataFrame, name: str = "search-index") -> Index:
    """Index every row of ``docs`` (doc_id, text): one pass for the statistics, one that writes the blocks."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = rows.select("text").mapInArrow(_counts, "docs long, words long").agg(F.sum("docs"), F.sum("words")).first()
    n_docs, n_terms = total[0] or 0, total[1] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, words, size, number = [], 0, 0, 0

        def full() -> pa.RecordBatch:
            made = _block(parts, n_docs, n_terms, number)
            arrays = [pa.array([made["block"]], pa.int64())] + [pa.array([made[c]]) for c in ("docs", "known", "terms", "dfs", "shape")]
            return pa.RecordBatch.from_arrays([*arrays, *[pa.array([made[c]], pa.binary()) for c in ("bits", "maxima", "rows", "columns")]], names=[c.split(" ")[0] for c in INDEX.split(", ")])

        for batch in batches:
            ids = batch.column("doc_id")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            for c in chunks(batch.column("text")):
                w = c.lower().words(ALNUM)
                has = w.counts > 0
                if not has.any():
                    continue
                here = slice(c.row, c.row + len(c))
                parts.append((ids[here][has], known[here][has], w.counts[has], w.hashes()))
                words, size = words + len(w.starts), size + len(c.bytes)
                if words >= BLOCK_WORDS or size >= BLOCK_BYTES:
                    yield full()
                    parts, words, size, number = [], 0, 0, number + 1
        if parts:
            yield full()

    blocks = spread(rows).mapInArrow(run, INDEX)
    return Index(materialize(blocks, name), n_docs, n_terms)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query, item_id, term): the distinct terms of every row of ``queries`` (item_id, text); ``query`` tells rows apart."""
    numbered = materialize(queries.select("item_id", "text").withColumn("query", F.monotonically_increasing_id()), "search-queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column("text")):
                w = c.lower().words(ALNUM)
                pairs = np.unique(np.stack([w.doc().astype(np.uint64), w.hashes()], axis=1), axis=0) if len(w.starts) else np.zeros((0, 2), np.uint64)
                row = pairs[:, 0].astype(np.int64) + c.row
                yield pa.RecordBatch.from_arrays([batch.column("query").take(pa.array(row)), pa.array(signed(pairs[:, 1].copy()))], names=["query", "term"])

    terms = numbered.select("query", "text").mapInArrow(run, "query long, term long")
    return terms.join(numbered.select("query", "item_id"), "query")


def weigh(index: Index, terms: DataFrame) -> DataFrame:
    """``terms`` with the weight of each term that occurs in the index."""
    here = index.blocks.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.dfs").alias("df"))
    df = here.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(WEIGHT * F.log((2.0 * index.n_docs + 2.0) / (2.0 * F.col("df") + 1.0)))
    return terms.join(df, "term").select("query", "item_id", "term", weight.cast("long").alias("weight")).where("weight > 0")


def _search(index: Index, part: DataFrame, k: int) -> DataFrame:
    """(query, score, doc_id, place): the best k of every task for the queries of one slice."""
    pairs = part.select("query", "term", "weight").orderBy("query", "term").toPandas()
    shared = index.blocks.sparkSession.sparkContext.broadcast(tuple(pairs[c].to_numpy(dtype=np.int64) for c in pairs.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, term, weight = shared.value
        names, first = np.unique(query, return_index=True)
        ends = np.append(first[1:], len(query))
        tops: list[list[tuple[int, bool, int, int]]] = [[] for _ in names]  # heaps, the worst of the best k first
        seen = 0
        for batch in batches:
            for b in range(batch.num_rows):
                get = lambda c: batch.column(c)[b]
                ids, known, terms = (get(c).values.to_numpy(zero_copy_only=False) for c in ("docs", "known", "terms"))
                terms = terms.view(np.uint64)
                treap = Treap(terms, get("shape").as_py(), *(get(c).as_py() for c in ("bits", "maxima", "rows", "columns")))
                wanted = term.view(np.uint64)
                at = np.searchsorted(terms, wanted)
                met = terms[np.minimum(at, len(terms) - 1)] == wanted
                for q in range(len(names)):
                    mine = slice(first[q], ends[q])
                    rows, weights = at[mine][met[mine]], weight[mine][met[mine]]
                    if not len(rows):
                        continue
                    top = tops[q]
                    columns, scores = treap.search(rows, weights, top[0][0] if len(top) == k else 1, k)
                    for c, s in zip(columns.tolist(), scores.tolist()):
                        entry = (s, bool(known[c]), -int(ids[c]), -(seen + c))
                        if len(top) < k:
                            heapq.heappush(top, entry)
                        elif entry > top[0]:
                            heapq.heapreplace(top, entry)
                seen += len(ids)
        rows = [(q, *e) for q, top in zip(names.tolist(), tops) for e in top]
        ids = pa.array([-r[3] if r[2] else None for r in rows], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), ids, pa.array([-r[4] for r in rows], pa.int64())], names=["query", "score", "doc_id", "place"]
        )

    columns = index.blocks.select("docs", "known", "terms", "shape", "bits", "maxima", "rows", "columns")
    hits = materialize(columns.mapInArrow(run, "query long, score long, doc_id long, place long"), "search-hits")
    shared.destroy()
    return hits


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = K, slice_pairs: int = SLICE_PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every row of ``queries``."""
    return search_index(build_index(docs), queries, k, slice_pairs)


def search_index(index: Index, queries: DataFrame, k: int = K, slice_pairs: int = SLICE_PAIRS) -> DataFrame:
    terms = materialize(weigh(index, materialize(query_terms(queries), "search-terms")), "search-weights")
    n_pairs = terms.count()
    slices = max(1, -(-n_pairs // slice_pairs))
    hits = None
    for s in range(slices):
        part = terms if slices == 1 else terms.where(F.pmod(F.xxhash64("query"), F.lit(slices)) == s)
        found = _search(index, part, k)
        hits = found if hits is None else hits.unionByName(found)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "place")
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = terms.select("query", "item_id").distinct()
    return best.join(names, "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
