"""Shared helpers: reading tables, and words and hashes of whole texts, a chunk of documents at a time.

Texts stay the UTF-8 bytes that Arrow hands over. Both word patterns in use cut at ASCII
characters only, so cutting bytes gives the words of the text. Hashes are 64-bit polynomials
over the bytes, read off one running sum per chunk and mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare as prepare_session

CHUNK_BYTES = 1 << 18
U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)

SPACES = [0x20, *range(0x09, 0x0E)]
#: Bytes of words cut at white space, and of words made of letters, digits and anything beyond ASCII.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[SPACES] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def prepare(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return prepare_session(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column) -> F.Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * BASE)
_powers = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, kept for chunks of up to 4 * CHUNK_BYTES."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    found = []
    for base in (BASE, U64(pow(int(BASE), -1, 1 << 64))):
        steps = np.full(max(n, CHUNK_BYTES + 1), base, dtype=U64)
        steps[0] = 1
        found.append(np.cumprod(steps))
    if n <= 4 * CHUNK_BYTES:
        _powers[:] = found
    return found[0], found[1]


class Chunk:
    """Some documents: ``bytes`` of all texts end to end, ``offsets`` of len(docs) + 1."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, row: int = 0):
        self.bytes, self.offsets, self.row = data, offsets, row

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lower(self) -> Chunk:
        return Chunk(LOWER[self.bytes], self.offsets, self.row)

    def take(self, rows: np.ndarray) -> Chunk:
        """The chunk of some of its documents."""
        parts = [self.bytes[self.offsets[i] : self.offsets[i + 1]] for i in rows]
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        return Chunk(np.concatenate(parts) if parts else self.bytes[:0], np.concatenate([[0], np.cumsum(sizes)]), self.row)

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value per byte, for each document."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return np.diff(total[self.offsets])

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of runs of marked bytes that don't cross documents; first run of each document."""
        before = np.zeros(len(inside), dtype=bool)
        before[1:] = inside[:-1]
        edges = self.offsets[:-1][self.offsets[:-1] < len(inside)]
        before[edges] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.zeros(len(inside), dtype=bool)
        after[:-1] = inside[1:]
        after[edges[edges > 0] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def prefix_sums(self) -> np.ndarray:
        n = len(self.bytes)
        total = np.empty(n + 1, dtype=U64)
        total[0] = 0
        np.cumsum(BYTE_CODES[self.bytes] * powers(n + 1)[0][:n], out=total[1:])
        return total

    def hashes(self, starts: np.ndarray, ends: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
        total = self.prefix_sums() if total is None else total
        return mix((total[ends] - total[starts]) * powers(len(total))[1][starts] + (ends - starts).astype(U64))

    def words(self, kind: np.ndarray) -> Words:
        starts, ends, first = self.runs(kind[self.bytes])
        return Words(self, starts, ends, first)


class Words:
    """Words of a chunk; those of document d are ``first[d]`` up to ``first[d + 1]``."""

    def __init__(self, chunk: Chunk, starts: np.ndarray, ends: np.ndarray, first: np.ndarray):
        self.chunk, self.starts, self.ends, self.first = chunk, starts, ends, first
        self.counts = np.diff(first)

    def hashes(self) -> np.ndarray:
        return self.chunk.hashes(self.starts, self.ends)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.chunk)), self.counts)

    def shingles(self, k: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first word and document of every run of k words within a document."""
        h = self.hashes() if hashes is None else hashes
        counts = np.maximum(self.counts - k + 1, 0)
        doc = np.repeat(np.arange(len(counts)), counts)
        at = ranges(self.first[:-1], counts)
        value = np.zeros(len(at), dtype=U64)
        for j in range(k):
            value = value * BASE + h[at + j]
        return mix(value), at, doc


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, count numbers of each."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    base = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return base + np.arange(total)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a column of texts into chunks of about ``limit`` bytes; null counts as empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(texts):
        to = max(int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1, at + 1)
        yield Chunk(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at)
        at = to


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def lists(first: np.ndarray, values: np.ndarray) -> pa.Array:
    """A list column from the place of each row's first value."""
    return pa.LargeListArray.from_arrays(pa.array(first.astype(np.int64)), pa.array(values)).cast(pa.list_(pa.from_numpy_dtype(values.dtype)))
