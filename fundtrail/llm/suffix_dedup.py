"""Exact removal of repeated byte strings by sparse suffix arrays and their common-prefix interval trees.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. Sorting every suffix of a
corpus would move it many times over, so suffixes are sorted at anchors only. The anchor of a window of ``length``
bytes is the first of its k-grams with the smallest hash: equal windows have it at the same offset, so a repeated
window always has a repeated anchor. Neighbouring windows mostly share theirs; such a run of windows is a block.

1. Anchors are counted by hash; those seen once have no repeated window (most of a corpus).
2. Blocks that are equal as a whole, from first window to last, are repeated as a whole.
3. Of an anchor with several different blocks, one of each is taken and their suffixes at the anchor are
   sorted: an enhanced suffix array with its longest common prefixes. A stack scan yields the prefix intervals.
   The members of an interval share R bytes to the right; sorted by what stands to the left, each shares M bytes
   with its nearest neighbour there. Where left extensions differ in this way, the members with their own
   M are the maximal repeats of R + M bytes, all occurrences included, and count from ``length`` bytes on.
4. Anchors with more than ``GROUP_BLOCKS`` different blocks are settled by counting the hashes of all their windows instead.

Matches never cross documents: windows lie inside one text. A null text counts as empty; texts under ``length``
bytes keep all. Rows that are equal in doc_id and text count as documents of their own, so each makes the other
a repeat. Equality of anchors, blocks and rows is that of 64-bit hashes. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .text import U64, Chunk, chunks, mix, powers, ranges, signed

LENGTH = 200
K = 64
GROUP_BLOCKS = 50_000
ANCHOR_SCHEMA = "ah long, bh long, doc long, lo long, hi long, at long"
PLACE_BITS = 24


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    n = len(values)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.ascontiguousarray(np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]).reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def blocks_of(c: Chunk, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, block hash, document, first and last window and anchor of every block; places in the chunk's bytes."""
    size = len(c.bytes)
    none = np.zeros(0, dtype=np.int64)
    sizes = np.diff(c.offsets)
    if size < length or sizes.max() < length:
        return none.view(np.uint64), none.view(np.uint64), none, none, none, none
    total = c.prefix_sums()
    anchor = np.empty(size - length + 1, dtype=np.int64)
    step = (1 << PLACE_BITS) - length
    for a in range(0, len(anchor), step):  # a text of more than 16 MB takes several steps
        b = min(a + step, len(anchor))
        at = slice(a, b + length - k)
        h = mix((total[at.start + k : at.stop + k] - total[at]) * powers(size + 1)[1][at])
        place = np.arange(b - a + length - k, dtype=U64)
        keys = (h >> U64(PLACE_BITS) << U64(PLACE_BITS)) | place
        anchor[a:b] = (sliding_min(keys, length - k + 1) & U64((1 << PLACE_BITS) - 1)).astype(np.int64) + a
    inside = np.zeros(len(anchor), dtype=bool)
    inside[ranges(c.offsets[:-1], np.maximum(sizes - length + 1, 0))] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1])
    last = inside.copy()
    last[:-1] &= ~inside[1:] | (anchor[1:] != anchor[:-1])
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    at = anchor[lo]
    ah = mix((total[at + k] - total[at]) * powers(size + 1)[1][at] + U64(k))
    bh = mix(c.hashes(lo, hi + length, total) + (at - lo).astype(U64))
    return ah, bh, np.searchsorted(c.offsets, lo, "right") - 1, lo, hi, at


def _anchors(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column("doc"))
            for c in chunks(batch.column("text")):
                ah, bh, doc, lo, hi, at = blocks_of(c, length, k)
                base = c.offsets[doc]
                columns = [signed(ah), signed(bh), keys[c.row + doc], lo - base, hi - base, at - base]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["ah", "bh", "doc", "lo", "hi", "at"])

    return run


def prefix_intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of every common-prefix interval of a suffix array; ``lcp[t]`` is of suffixes t - 1 and t."""
    stack = [(0, 0)]
    for t in range(1, len(lcp) + 1):
        h, first = lcp[t] if t < len(lcp) else -1, t - 1
        while stack and stack[-1][0] > h:
            depth, first = stack.pop()
            yield depth, first, t - 1
        if not stack or stack[-1][0] < h:
            stack.append((h, first))


def _common(a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows of two byte matrices, at most ``limit``."""
    differ = a != b
    n = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(n, limit)


def _matrix(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in parts])
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), dtype=np.uint8).reshape(len(parts), width), sizes


def repeats(lefts: list[bytes], rights: list[bytes], group: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(block, M, R) for the maximal repeats of every group of different blocks around one anchor.

    ``lefts`` are reversed, so both sides read away from the anchor. ``group`` numbers the blocks' anchors.
    """
    order = sorted(range(len(rights)), key=lambda i: (group[i], rights[i]))
    right, right_size = _matrix([rights[i] for i in order], length)
    left, left_size = _matrix([lefts[i] for i in order], length)
    owner = np.asarray(group)[order]
    lcp = np.zeros(len(order), dtype=np.int64)
    lcp[1:] = _common(right[1:], right[:-1], np.minimum(right_size[1:], right_size[:-1]))
    lcs = np.zeros(len(order), dtype=np.int64)
    lcs[1:] = _common(left[1:], left[:-1], np.minimum(left_size[1:], left_size[:-1]))
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    stops = np.append(starts[1:], len(order))
    out = []
    # Two blocks are the one interval of their group.
    two = starts[(stops - starts == 2)]
    for a in two[lcp[two + 1] + lcs[two + 1] >= length]:
        m, r = int(lcs[a + 1]), int(lcp[a + 1])
        out += [(order[a], m, r), (order[a + 1], m, r)]
    for a, b in zip(starts, stops, strict=True):
        if b - a < 3:
            continue
        by_left = np.array(sorted(range(a, b), key=lambda t: lefts[order[t]]))
        rank = np.empty(b - a, dtype=np.int64)
        rank[by_left - a] = np.arange(b - a)
        for r, i, j in prefix_intervals([0, *lcp[a + 1 : b].tolist()]):
            if j == i or r + int(left_size[a + i : a + j + 1].max()) < length:
                continue
            members = by_left[np.sort(rank[i : j + 1])]
            near = _common(left[members[1:]], left[members[:-1]], np.minimum(left_size[members[1:]], left_size[members[:-1]]))
            best = np.maximum(np.append(near, 0), np.concatenate([[0], near]))
            out += [(order[t], int(m), r) for t, m in zip(members[best + r >= length].tolist(), best[best + r >= length], strict=True)]
    return out


def _interval_marks(length: int):
    """Marks from blocks that come sorted by anchor; a group may span batches."""

    def marks(rows: list[dict]) -> pa.RecordBatch:
        ids = np.array([r["ah"] for r in rows])
        found = repeats([r["left"][::-1] for r in rows], [r["right"] for r in rows], ids, length) if rows else []
        found = [(rows[i]["doc"], rows[i]["at"] - m, rows[i]["at"] + r) for i, m, r in found if rows[i]["n"] == 1]
        doc, a, b = zip(*found, strict=True) if found else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["doc", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            held += batch.to_pylist()
            if len(held) >= 4000 and held[0]["ah"] != held[-1]["ah"]:
                cut = next(i for i in range(len(held) - 1, -1, -1) if held[i]["ah"] != held[-1]["ah"]) + 1
                yield marks(held[:cut])
                held = held[cut:]
        yield marks(held)

    return run


def _block_bytes(length: int):
    """Bytes on either side of the anchor of each wanted block, from the texts that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["ah", "doc", "at", "n", "left", "right"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        for batch in batches:
            out = []
            for doc, text, wanted in zip(batch.column("doc").to_pylist(), batch.column("text"), batch.column("wanted").to_pylist(), strict=True):
                data = text.as_buffer()
                for w in wanted:
                    left, right = data[w["lo"] : w["at"]], data[w["at"] : w["hi"] + length]
                    out.append((w["ah"], doc, w["at"], w["n"], left.to_pybytes(), right.to_pybytes()))
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, types, strict=True)], names=names)

    return run


def _window_rows(length: int):
    """Hash and place of every window of the wanted blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("wanted").to_pylist()
            for c in chunks(batch.column("text")):
                total = c.prefix_sums()
                rows = [(c.row + d, w) for d in range(len(c)) for w in wanted[c.row + d]]
                n = np.array([w["hi"] - w["lo"] + 1 for _, w in rows], dtype=np.int64)
                base = c.offsets[np.array([d - c.row for d, _ in rows], dtype=np.int64)]
                start = ranges(np.array([w["lo"] for _, w in rows], dtype=np.int64) + base, n)
                h = c.hashes(start, start + length, total)
                doc = np.repeat(np.asarray(batch.column("doc"))[np.array([d for d, _ in rows], dtype=np.int64)], n)
                own = np.repeat(np.array([w["n"] for _, w in rows], dtype=np.int64), n)
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(doc), pa.array(start - np.repeat(base, n)), pa.array(own)], names=["h", "doc", "at", "n"])

    return run


def repeated_ranges(texts: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """(doc, start, stop): byte ranges to remove, overlapping as found, of ``texts`` (doc, text)."""
    anchors = texts.mapInArrow(_anchors(length, k), ANCHOR_SCHEMA)
    often = anchors.groupBy("ah").count().where("count > 1").select("ah")
    blocks = materialize(anchors.join(often, "ah"), "repeated-anchors")
    sole = F.struct("doc", "lo", "hi", "at")
    kinds = materialize(blocks.groupBy("ah", "bh").agg(F.count(F.lit(1)).alias("n"), F.min(sole).alias("one")), "blocks")
    whole = blocks.join(kinds.where("n > 1").select("ah", "bh"), ["ah", "bh"]).select("doc", F.col("lo").alias("start"), (F.col("hi") + length).alias("stop"))

    mixed = kinds.groupBy("ah").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    wanted = materialize(kinds.join(mixed, "ah").select("ah", "n", "kinds", "one.*"), "mixed-blocks")

    def with_text(part: DataFrame) -> DataFrame:
        per_doc = part.groupBy("doc").agg(F.collect_list(F.struct("ah", "lo", "hi", "at", "n")).alias("wanted"))
        return texts.join(per_doc, "doc").select("doc", "text", "wanted")

    shared = with_text(wanted.where(F.col("kinds") <= GROUP_BLOCKS)).mapInArrow(_block_bytes(length), "ah long, doc long, at long, n long, left binary, right binary")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_interval = shared.repartition(parts, "ah").sortWithinPartitions("ah").mapInArrow(_interval_marks(length), "doc long, start long, stop long")
    out = whole.unionByName(by_interval)
    hot = wanted.where(F.col("kinds") > GROUP_BLOCKS)
    if hot.take(1):
        windows = materialize(with_text(hot).mapInArrow(_window_rows(length), "h long, doc long, at long, n long"), "hot-windows")
        again = windows.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
        out = out.unionByName(windows.where("n = 1").join(again, "h").select("doc", F.col("at").alias("start"), (F.col("at") + length).alias("stop")))
    return out


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for batch in batches:
        figures = []
        for text, found in zip(batch.column("text"), batch.column("found").to_pylist(), strict=True):
            data = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
            at, removed, spans, digest = 0, 0, 0, hashlib.sha256()
            for a, b in sorted((f["start"], f["stop"]) for f in found or []):
                if a > at or not spans:
                    digest.update(data[at:a])
                    spans, removed, at = spans + 1, removed + b - a, b
                elif b > at:
                    removed, at = removed + b - at, b
            digest.update(data[at:])
            figures.append((len(data), removed, spans, digest.hexdigest()))
        n, r, s, d = zip(*figures, strict=True) if figures else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.int64()), pa.array(d, pa.string())], names=names)


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs`` (doc_id, text)."""
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("doc"))
    found = repeated_ranges(keyed.select("doc", "text"), length, k)
    per_doc = materialize(found.groupBy("doc").agg(F.collect_set(F.struct("start", "stop")).alias("found")), "repeated-ranges")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return keyed.join(per_doc, "doc", "left").select("doc_id", "text", "found").mapInArrow(_removed, schema)
