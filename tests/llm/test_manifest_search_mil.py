"""Merkle manifest, ranked search and passage classifier against brute force, and their small cases."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fundtrail.llm import merkle, quality_mil, ranked_search
from fundtrail.llm.text import Chunk

EXTRA = "key string, grp string, place string, row string, score string, leaf string, n string, digest string, path string"
CLASH = ("k", "g", "p", "r", "s", "l", "n", "d", "h")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], f"{schema}, {EXTRA}")


# --- Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    doc_id, text, lang, source, n_chars = row
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def climb(nodes):
    """All levels of a tree, lowest first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha(*below[i : i + 8]) for i in range(0, len(below), 8)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        run = at // 8 * 8
        out.append((level[run:at], level[at + 1 : run + 8]))
        at //= 8
    return out


def brute_manifest(rows):
    """For every row its subroot, root and proof, keyed by (doc_id, leaf)."""
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees, members = {}, {}
    for lang in langs:
        members[lang] = sorted(((r[0] is not None, r[0] or 0, leaf_of(r)), r[0]) for r in rows if r[2] == lang)
        trees[lang] = climb([m[0][2] for m in members[lang]])
    top = climb([trees[g][-1][0] for g in langs])
    out = []
    for at, lang in enumerate(langs):
        for i, (order, doc_id) in enumerate(members[lang]):
            out.append((doc_id, order[2], trees[lang][-1][0], top[-1][0], siblings(trees[lang], i) + siblings(top, at)))
    return out


def made_rows():
    rows = [(i, f"text {i} é" * (i % 3), ["en", "de", None, "é", ""][i % 7 % 5], f"s{i % 2}" if i % 5 else None, i if i % 4 else None) for i in range(180)]
    rows += [(7, None, "en", None, None), (7, "", "en", None, None), (7, "", "en", None, None), (None, "x", "en", "s", 1), (None, None, None, None, None)]
    rows += [(1000, "alone", "fr", "s", 1), (2000, "long " * 50_000, "en", "s", 1)]
    return rows


@pytest.mark.parametrize("n", [1, 9, 187])
def test_proofs_equal_brute_force(spark, n):
    rows = made_rows()[-n:]
    manifest = merkle.build_manifest(frame(spark, rows, DOCS))
    found = merkle.prove(manifest).collect()
    got = [(r["key"], r["leaf"], r["subroot"], manifest.root, [(s["before"], s["after"]) for s in r["proof"]]) for r in found]
    want = [(*w[:4], [("".join(a), "".join(b)) for a, b in w[4]]) for w in brute_manifest(rows)]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) == n


def test_only_true_claims_fold_to_the_root(spark):
    rows = made_rows()
    claim = F.when(F.col("doc_id") % 2 == 0, merkle.leaf_digest()).otherwise(F.sha2(F.lit("other"), 256))
    manifest = merkle.build_manifest(frame(spark, rows, DOCS), carry={"claim": claim})
    for r in merkle.verify(manifest, manifest.leaves).collect():
        assert r["verified"] == (r["key"] is not None and r["key"] % 2 == 0) == (r["folded_root"] == manifest.root)


def test_some_requests_get_the_proofs_they_get_among_all(spark):
    manifest = merkle.build_manifest(frame(spark, made_rows(), DOCS))
    everyone = {(r["grp_no"], r["place"]): r["proof"] for r in merkle.prove(manifest).collect()}
    few = manifest.leaves.where("place % 37 = 3").select("grp_no", "place")
    beyond = spark.createDataFrame([(0, 10**6), (99, 0)], "grp_no long, place long")
    got = {(r["grp_no"], r["place"]): r["proof"] for r in merkle.prove(manifest, few.unionByName(beyond)).collect()}
    assert got == {k: everyone[k] for k in got} and len(got) == few.count() > 3


def test_equal_subtrees_are_stored_once_and_an_empty_table_has_no_root(spark):
    manifest = merkle.build_manifest(spark.createDataFrame([(1, "same", "en", "s", 4)] * 130, DOCS))
    assert [level.count() for level in manifest.levels] == [2, 2, 1]
    assert {len(r["proof"]) for r in merkle.prove(manifest).collect()} == {3}
    nothing = merkle.build_manifest(spark.createDataFrame([], DOCS), carry={"claim": F.lit("x")})
    assert nothing.root is None and merkle.verify(nothing, nothing.leaves).collect() == []


# --- ranked search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_search(docs, items, k):
    words = [Counter(w.translate(LOWER) for w in WORD.findall(text or "")) for _, text in docs]
    n_docs, n_terms = sum(1 for w in words if w), sum(w.total() for w in words)
    df = Counter(t for w in words for t in w)
    out = []
    for item_id, text in items:
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in {w.translate(LOWER) for w in WORD.findall(text or "")}}
        scored = []
        for (doc_id, _), w in zip(docs, words):
            m = 50 + 50 * w.total() * n_docs // n_terms if n_terms else 0
            s = sum(weights[t] * (1_000_000_000 * w[t] // (1000 * w[t] + 20 * m)) for t in weights if t in w)
            if s > 0:
                scored.append((-s, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, i + 1, e[3], -e[0]) for i, e in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def corpus(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    pick = lambda size: " ".join(f"W{int(x)}" for x in np.minimum(rng.zipf(1.3, size), vocabulary))
    docs = [(i, pick(int(rng.integers(1, 120)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "!? ."), (None, docs[3][1]), (5, docs[5][1]), (5, docs[5][1]), (n + 3, "w3 " * 30_000), (n + 4, "É w3-w9_W7")]
    return docs, [(i, pick(12)) for i in range(9)] + [(None, "w1 w2"), (3, "w399 w5"), (20, None), (21, "unheardof"), (22, "É")]


@pytest.mark.parametrize("block, k, pairs", [(1 << 20, 50, 1 << 17), (700, 5, 20), (1, 3, 1 << 17)])
def test_search_equals_brute_force(spark, monkeypatch, block, k, pairs):
    monkeypatch.setattr(ranked_search, "BLOCK_WORDS", block)
    monkeypatch.setattr(ranked_search, "BATCH", 16)
    docs, items = corpus(block, 260)
    found = ranked_search.ranked_search(frame(spark, docs, "doc_id long, text string"), frame(spark, items, "item_id long, text string"), k, pairs)
    assert sorted([tuple(r) for r in found.collect()], key=repr) == brute_search(docs, items, k)


def test_search_of_empty_tables(spark):
    docs, items = corpus(1, 8)
    d, i = frame(spark, docs, "doc_id long, text string"), frame(spark, items, "item_id long, text string")
    assert ranked_search.ranked_search(d.limit(0), i).collect() == ranked_search.ranked_search(d, i.limit(0)).collect() == []


def test_tree_holds_every_entry_and_bounds_it():
    rng = np.random.default_rng(3)
    cell = rng.choice(64 * 200, 900, replace=False)
    rows, columns, value = cell // 64, cell % 64, rng.integers(1, 10**6, 900)
    bits, maxima, leaf_rows, leaf_columns = ranked_search.build_tree(rows, columns, value, 8)
    packed = [ranked_search.pack(a, t) for a, t in zip((bits, maxima, leaf_rows, leaf_columns), ("u1", "<i4", "<i4", "<i4"))]
    treap = ranked_search.Treap(np.arange(200, dtype=np.uint64), [8], *packed)
    leaves = {(int(r), int(c)): int(b) for r, c, b in zip(treap.row[:-1], treap.column[:-1], treap.best[:-1]) if r >= 0}
    assert leaves == {(int(r), int(c)): int(v) for r, c, v in zip(rows, columns, value)}
    kids = treap.child[treap.child.max(axis=1) >= 0]
    assert treap.best[0] == value.max() and len(kids) + 900 == len(bits)


# --- passage classifier


def test_passages_cover_every_word_evenly():
    n, first = quality_mil.passages(np.array([0, 1, 47, 72, 500]))
    assert n.tolist() == [1, 1, 1, 2, 10] and first.tolist() == [0, 0, 0, 0, 36, *range(0, 500, 50)]


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    texts = [b"", b"One two three. " * 60, b"   ", "é ÜBER SHOUTING!! 12 12".encode(), b"tail"]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    together, n, _, counts = quality_mil.encode(Chunk(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets))
    at = 0
    for i, t in enumerate(texts):
        alone, m, _, c = quality_mil.encode(Chunk(np.frombuffer(t, dtype=np.uint8), np.array([0, len(t)])))
        assert m[0] == n[i] and c[0] == counts[i] == len(t.decode().split()) and np.allclose(alone, together[at : at + n[i]])
        at += n[i]


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(5)
    sizes = dict(encode=(6, 4), encode_bias=(4,), tanh=(4, 3), gate=(4, 3), attend=(3,), unit=(4,), bias=(1,))
    p = {k: rng.normal(0, 0.5, s) for k, s in sizes.items()}
    x, n, y = rng.normal(0, 1, (9, 6)), np.array([1, 5, 3]), np.array([1.0, 0.0, 0.3])
    loss = lambda: float(-(y * np.log(s := quality_mil.forward(x, n, p)[0]) + (1 - y) * np.log(1 - s)).mean())
    score, a, kept = quality_mil.forward(x, n, p)
    assert np.allclose(np.add.reduceat(a, [0, 1, 6]), 1)
    for k, grad in quality_mil.backward(x, y, score, a, kept, p).items():
        for i in np.ndindex(p[k].shape):
            old = p[k][i]
            p[k][i] = old + 1e-6
            up = loss()
            p[k][i] = old - 1e-6
            assert (up - loss()) / 2e-6 == pytest.approx(grad[i], abs=1e-6)
            p[k][i] = old


def test_one_bad_passage_decides_and_is_shown(spark):
    rng = np.random.default_rng(9)
    plain = lambda n: " ".join(f"word{int(x)}" for x in rng.integers(0, 80, n))
    rows, labels = [], []
    for i in range(240):
        parts = [plain(48) for _ in range(6)]
        if i % 2:
            parts[i % 6] = " ".join(f"JUNK{int(x)}##" for x in rng.integers(0, 30, 48))
        rows.append((i, "\n".join(parts)))
        labels.append((i, float(1 - i % 2)))
    rows += [(500, None), (501, ""), (None, "word1 word2"), (3, rows[3][1]), (600, plain(60_000))]
    labels += [(None, 0.0), (500, None), (3, 0.0)]
    docs = frame(spark, rows, "doc_id long, text string")
    found = quality_mil.classify(docs, spark.createDataFrame(labels, "doc_id long, label double")).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 and (r["score"] >= 0.5) == r["predicted"] for r in found)
    judged = [r for r in found if r["doc_id"] is not None and r["doc_id"] < 240]
    assert np.mean([r["predicted"] == 1 - r["doc_id"] % 2 for r in judged if r["held_out"]]) >= 0.95
    assert np.mean([r["top_start"] == 48 * (r["doc_id"] % 6) for r in judged if r["doc_id"] % 2]) >= 0.9
    scores = {}
    for r in found:
        scores.setdefault(r["doc_id"], set()).add(r["score"])
    assert len(scores[3]) == 1 and scores[500] == scores[501]
    nothing = quality_mil.classify(docs, spark.createDataFrame([], "doc_id long, label double"))
    assert {r["score"] for r in nothing.collect()} == {0.5}
    assert quality_mil.classify(docs.limit(0), spark.createDataFrame(labels, "doc_id long, label double")).collect() == []


def test_held_out_quality(spark, sf_dir):
    from fundtrail.llm import queries

    found = queries.queries()["op13_quality_mil"](spark, sf_dir).where("held_out")
    judged = found.join(spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null"), "doc_id")
    right = judged.groupBy("quality").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")).alias("right")).collect()
    assert len(right) == 2 and all(r["right"] >= 0.9 for r in right)
