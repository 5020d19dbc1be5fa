"""Token ids in blocks of bit or byte planes.

Documents are range partitioned by doc_id and encoded in that order; a write task is a shard. A shard holds
segments, rows of about ``SEGMENT_IDS`` ids that start and end with a document. In a segment
the ids stand end to end in blocks of a fixed number of ids; each block is transposed into planes (the
j-th byte, or the j-th bit, of every id) and each plane compressed with zstandard. High planes are nearly
constant and vanish, low ones compress by themselves.

On storage there are two Parquet folders, so that any store that Spark reaches will do and task commits
protect against lost executors:

- ``data``: shard, segment, first (ids of the shard before it), doc_ids, lengths, blocks (planes);
- ``chunks``, the chunk index: shard, segment, block, first, n_ids, plane_bytes.

A null text counts as empty and yields the end id alone; rows of one doc_id follow in order of their texts; a
null doc_id comes first. An empty table gives empty folders. A document longer than a segment is a
segment of its own, cut into blocks like any other.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .text import ranges

BLOCK_IDS = 1 << 16
SEGMENT_IDS = 1 << 20
CACHED_PIECES = 1_000_000
BATCH_BYTES = 1 << 22
#: New pieces that go to the tokenizer in one call.
NEW_PIECES = 1 << 14
END_ID = 0
DATA_SCHEMA = "shard int, segment int, first long, doc_ids array<long>, lengths array<long>, blocks array<array<binary>>"
READ_SCHEMA = "shard int, doc_id long, at long, n_tokens long, ids_crc32 long"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Ends in a letter or digit, as every version of Unicode has it.
ENDS_BODY = r"[0-9A-Za-zÀ-ÖØ-öø-ɏ]\z"
WHITE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


class Pieces:
    """Ids of strings, end to end: those of string k are ``flat[starts[k] : starts[k + 1]]``. The empty string has none."""

    def __init__(self):
        self.number: dict[str, int] = {"": 0}
        self.flat = np.zeros(1 << 16, dtype="<u4")
        self.starts = np.zeros(1 << 14, dtype=np.int64)

    def add(self, new: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        n = len(self.number)
        at = int(self.starts[n])
        self.flat, self.starts = _room(self.flat, at, len(ids)), _room(self.starts, n + 1, len(new))
        self.flat[at : at + len(ids)] = ids
        self.starts[n + 1 : n + 1 + len(new)] = at + np.cumsum(counts)
        self.number.update(zip(new, range(n, n + len(new)), strict=True))

    def take(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of known strings end to end, and how many each has."""
        at = np.fromiter(map(self.number.__getitem__, strings), np.int64, len(strings))
        counts = self.starts[at + 1] - self.starts[at]
        return self.flat[ranges(self.starts[at], counts)], counts


def _room(values: np.ndarray, used: int, more: int) -> np.ndarray:
    return values if used + more <= len(values) else np.concatenate([values[:used], np.zeros(used + more, dtype=values.dtype)])


class Encoder:
    """Encodes whole texts, cutting them where the tokenizer cuts anyway.

    Its pre-tokenizer never joins what stands on either side of a single space or line feed between non-spaces. A space
    goes with the piece that it leads, a line feed is a token by itself, and so are both of two line feeds ahead of a non-space. So
    such a text is its pieces, each led by its space or feed, the first by neither. Nor does it join a letter or digit with ASCII
    punctuation after it, so a piece that ends in punctuation is a body and a tail, each encoded by itself. Texts with other white
    space beside a space or feed, or with an added token's string, go to the tokenizer whole. Arrow cuts some texts together and
    finds their distinct pieces; only these are looked up. Bodies that they have anew are encoded in one call and told apart by their
    first ids: a space is a body's first byte and in no other place, so it is only in the first of the body's ids.
    Bodies and tails are kept in two generations: once the younger is full the older goes, and those in use come over.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: What sends a text to the tokenizer whole.
        self.odd = "|".join(["  ", "\n ", " \n", "\n\n\n", r" \z", r"\n\n\z", f"[{''.join(WHITE)}]", *map(re.escape, special)])
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        twice = self.tokenizer.encode("a\n\nb", add_special_tokens=False).ids
        words = self.tokenizer.get_vocab()
        #: Which ids begin with a space, as byte-level tokenizers write it.
        self.spaced = np.zeros(max(words.values(), default=0) + 1, dtype=bool)
        self.spaced[[i for w, i in words.items() if w[:1] == "Ġ"]] = True
        #: The id of a line feed, if two of them ahead of a letter are just that id twice.
        self.feed = feed[0] if len(feed) == 1 and twice[1:-1] == feed * 2 else None
        self.bodies, self.older = Pieces(), Pieces()
        self.tails, self.older_tails = Pieces(), Pieces()

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def learn(self, new: list[str], lead: str) -> None:
        """Put new bodies with the known ones, all led by a space or all by a line feed; that space is not in their keys."""
        text = "".join(new) if lead else " " + " ".join(new)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        starts = np.flatnonzero(ids == self.feed if lead else self.spaced[ids])
        if len(starts) == len(new):
            self.bodies.add(new, ids, np.diff(np.append(starts, len(ids))))
        else:
            self.learn_each(self.bodies, new, "" if lead else " ")

    def learn_each(self, known: Pieces, new: list[str], lead: str = "") -> None:
        found = [self.encode(lead + p) for p in new]
        known.add(new, np.concatenate(found), np.array([len(x) for x in found]))

    def ids_of_bodies(self, wanted: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some distinct bodies end to end, and how many each has; new bodies are learnt."""
        if len(self.bodies.number) + len(wanted) > CACHED_PIECES // 2:
            self.bodies, self.older = Pieces(), self.bodies
        missing = _carry(wanted, self.bodies, self.older)
        for lead in ("\n", ""):
            new = [p for p in missing if (p[0] == "\n") == bool(lead)]
            for i in range(0, len(new), NEW_PIECES):
                self.learn(new[i : i + NEW_PIECES], lead)
        return self.bodies.take(wanted)

    def ids_of_tails(self, wanted: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.tails.number) + len(wanted) > CACHED_PIECES // 2:
            self.tails, self.older_tails = Pieces(), self.tails
        missing = _carry(wanted, self.tails, self.older_tails)
        if missing:
            self.learn_each(self.tails, missing)
        return self.tails.take(wanted)

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that are their pieces, end to end, and how many each text has."""
        led = np.asarray(pc.match_substring_regex(texts, r"\A(?: |\n|\z)"))
        fed = pc.if_else(pa.array(led), texts, pc.binary_replace_slice(texts, 0, 0, "\n"))
        cut = pc.split_pattern(pc.replace_substring(fed, "\n", " \n"), " ")
        coded = cut.flatten().dictionary_encode()
        bodies, tails = (x.dictionary_encode() for x in _bodies_and_tails(coded.dictionary))
        counts = []
        flats = []
        for part, known in ((bodies, self.ids_of_bodies), (tails, self.ids_of_tails)):
            ids, n = known(part.dictionary.to_pylist())
            rows = np.asarray(part.indices)
            flats.append(ids[ranges((np.cumsum(n) - n)[rows], n[rows])])
            counts.append(n[rows])
        n = counts[0] + counts[1]
        starts = np.cumsum(n) - n
        ids = np.empty(int(n.sum()), dtype="<u4")
        ids[ranges(starts, counts[0])] = flats[0]
        ids[ranges(starts + counts[0], counts[1])] = flats[1]
        at = np.asarray(coded.indices)
        n = n[at]
        total = np.concatenate([[0], np.cumsum(n)])[np.asarray(cut.offsets)]
        # The line feed put ahead of a text is its first id.
        return np.delete(ids[ranges(starts[at], n)], total[:-1][~led]), np.diff(total) - ~led

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end as little-endian unsigned 32-bit integers, and how many each text has."""
        whole = np.asarray(pc.match_substring_regex(texts, self.odd)) if self.feed is not None else np.ones(len(texts), dtype=bool)
        if not whole.any():
            return self.cut(texts)
        apart = [self.encode(t) for t in texts.filter(pa.array(whole)).to_pylist()]
        n = np.zeros(len(texts), dtype=np.int64)
        n[whole] = [len(x) for x in apart]
        cut, n[~whole] = self.cut(texts.filter(pa.array(~whole)))
        starts = np.cumsum(n) - n
        ids = np.empty(int(n.sum()), dtype="<u4")
        ids[ranges(starts[whole], n[whole])] = np.concatenate(apart)
        ids[ranges(starts[~whole], n[~whole])] = cut
        return ids, n

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, n = self.ids(pa.array(texts, pa.large_string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(n)[:-1])] if texts else []


def _carry(wanted: list[str], known: Pieces, older: Pieces) -> list[str]:
    """Take from the older generation what is wanted and not in the younger; what is in neither is returned."""
    missing = [p for p in wanted if p not in known.number]
    old = [p for p in missing if p in older.number]
    if old:
        known.add(old, *older.take(old))
        missing = [p for p in missing if p not in older.number]
    return missing


def _bodies_and_tails(pieces: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Cut the punctuation at the end of pieces off, where a letter or digit stands before it."""
    bodies = pc.ascii_rtrim(pieces, PUNCTUATION)
    bodies = pc.if_else(pc.match_substring_regex(bodies, ENDS_BODY), bodies, pieces)
    _, offsets, data = pieces.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[pieces.offset + 1 : pieces.offset + len(pieces) + 1]
    n = np.asarray(pc.subtract(pc.binary_length(pieces), pc.binary_length(bodies)))
    tails = np.frombuffer(data, dtype=np.uint8)[ranges(ends - n, n)] if n.any() else np.zeros(0, dtype=np.uint8)
    at = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    return bodies, pa.LargeStringArray.from_buffers(len(pieces), pa.py_buffer(at), pa.py_buffer(tails))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Byte planes, or bit planes, of a block of ids; each compressed by itself."""
    rows = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        planes = np.packbits(np.unpackbits(rows, axis=1, bitorder="little").T, axis=1, bitorder="little")
    else:
        planes = np.ascontiguousarray(rows.T)
    pack = zstandard.ZstdCompressor(level=3)
    return [pack.compress(p.tobytes()) for p in planes]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    unpack = zstandard.ZstdDecompressor()
    rows = [np.frombuffer(unpack.decompress(p), dtype=np.uint8) for p in planes]
    if len(rows) == 32:
        bits = np.stack([np.unpackbits(r, bitorder="little", count=n) for r in rows], axis=1)
        return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")
    return np.stack(rows, axis=1).reshape(-1).view("<u4")


def _segments(batches: Iterator[pa.RecordBatch], path: str, kind: str, block_ids: int, segment_ids: int) -> Iterator[pa.RecordBatch]:
    shard, encode = TaskContext.get().partitionId(), encoder(path)
    state = {"segment": 0, "first": 0}
    doc_ids: list[int | None] = []
    parts: list[np.ndarray] = []

    def row() -> pa.RecordBatch:
        ids = np.concatenate(parts)
        blocks = [to_planes(ids[i : i + block_ids], kind) for i in range(0, len(ids), block_ids)]
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([shard], pa.int32()), pa.array([state["segment"]], pa.int32()), pa.array([state["first"]], pa.int64()),
                pa.array([doc_ids], pa.list_(pa.int64())), pa.array([[len(p) for p in parts]], pa.list_(pa.int64())),
                pa.array([blocks], pa.list_(pa.list_(pa.binary()))),
            ],
            names=["shard", "segment", "first", "doc_ids", "lengths", "blocks"],
        )
        state["segment"] += 1
        state["first"] += len(ids)
        doc_ids.clear()
        parts.clear()
        return out

    held = 0
    for batch in batches:
        ids_of, texts = batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_string()).fill_null("")
        cuts = np.cumsum(np.asarray(pc.binary_length(texts))) // BATCH_BYTES
        for run in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(cuts)) + 1):
            if not len(run):
                continue
            ids, n = encode.ids(texts.slice(run[0], len(run)))
            ends = np.cumsum(n + 1)
            ids = np.insert(ids, np.cumsum(n), END_ID)
            for i, a, b in zip(run, ends - n - 1, ends, strict=True):
                if held and held + b - a > segment_ids:
                    yield row()
                    held = 0
                doc_ids.append(ids_of[i])
                parts.append(ids[a:b])
                held += b - a
    if doc_ids:
        yield row()


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, planes: str = "byte", block_ids: int = BLOCK_IDS, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode ``docs`` (doc_id, text), append the end id to each document and write data and chunk index."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    data = ordered.mapInArrow(lambda batches: _segments(batches, tokenizer, planes, block_ids, segment_ids), DATA_SCHEMA)
    data.write.parquet(f"{folder}/data")
    block = F.posexplode(F.transform("blocks", lambda b: F.transform(b, F.octet_length))).alias("block", "plane_bytes")
    index = spark.read.schema(DATA_SCHEMA).parquet(f"{folder}/data").select(
        "shard", "segment", "first", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("_n"), block
    )
    at = F.col("block").cast("long") * block_ids
    index.select(
        "shard", "segment", "block", (F.col("first") + at).alias("first"),
        F.least(F.lit(block_ids).cast("long"), F.col("_n") - at).alias("n_ids"), "plane_bytes",
    ).write.parquet(f"{folder}/chunks")


def _documents(batches: Iterator[pa.RecordBatch], block_ids: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            total = sum(r["lengths"])
            ids = [from_planes(b, min(block_ids, total - i * block_ids)) for i, b in enumerate(r["blocks"])]
            data = memoryview(np.ascontiguousarray(np.concatenate(ids) if ids else np.zeros(0, dtype="<u4")).view(np.uint8))
            ends = np.cumsum(r["lengths"])
            starts = ends - r["lengths"]
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)]
            n = len(crc)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["shard"]] * n, pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(starts + r["first"]), pa.array(r["lengths"], pa.int64()), pa.array(crc, pa.int64())],
                names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def read_documents(docs_folder: str, spark, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone.

    ``start`` adds the ids of earlier shards, known from the chunk index; that table has one row per write task.
    """
    data = spark.read.schema(DATA_SCHEMA).parquet(f"{docs_folder}/data")
    totals = spark.read.parquet(f"{docs_folder}/chunks").groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    read = data.mapInArrow(lambda batches: _documents(batches, block_ids), READ_SCHEMA)
    return read.join(F.broadcast(base), "shard").select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def tokens_of(docs: DataFrame, tokenizer: str, planes: str = "byte") -> DataFrame:
    """Write ``docs`` to a folder of this application and read every document back."""
    folder = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, folder, tokenizer, planes)
    return read_documents(folder, docs.sparkSession)
