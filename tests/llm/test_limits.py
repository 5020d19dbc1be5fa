"""What steps hold in memory and how often they move rows."""

import tracemalloc
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa

import corpus_pipeline
from fundtrail import session
from fundtrail.llm import decontaminate, ngram_join, token_store
from fundtrail.llm.queries import tokenizer_path
from fundtrail.operators.components import connected_components


def cell(sets, block, i, j, copies=None):
    where = pa.array([{"i": i, "j": j}] * len(sets))
    return pa.table({
        "sid": pa.array(range(100, 100 + len(sets)), pa.int64()), "copies": pa.array(copies or [1] * len(sets), pa.int64()), "block": pa.array(block, pa.int32()),
        "tokens": pa.array([sorted(s) for s in sets], pa.list_(pa.int64())), "cell": where,
    })


def test_cell_links_what_brute_force_links():
    rng = np.random.default_rng(3)
    bases = [rng.choice(5000, 40, replace=False) for _ in range(25)]
    sets = [set(map(int, rng.permutation(bases[k % 25])[: rng.integers(33, 41)])) for k in range(700)]
    copies = [int(x) for x in rng.integers(1, 4, 700)]
    block = [int(x) for x in rng.integers(0, 2, 700)]
    link = [[a != b and 100 * len(x & y) >= 80 * len(x | y) for b, y in enumerate(sets)] for a, x in enumerate(sets)]
    for i, j in ((0, 0), (0, 1), (1, 1)):
        own = [k for k in range(700) if block[k] in (i, j)]
        ok = lambda a, b: link[a][b] and (i == j or block[a] != block[b])
        got = ngram_join._cell(80)(None, cell([sets[k] for k in own], [block[k] for k in own], i, j, [copies[k] for k in own])).to_pydict()
        assert got["links"] == [sum(copies[b] for b in own if ok(a, b)) for a in own]
        root = {a: a for a in own}
        for _ in range(len(own)):
            low = {a: min([root[a], *(root[b] for b in own if ok(a, b))]) for a in own}
            if low == root:
                break
            root = low
        assert got["root"] == [100 + own.index(root[a]) for a in own]
    alone = ngram_join._cell(80)(None, cell([{1, 2}, {1, 2, 3}], [0, 0], 0, 1)).to_pydict()
    assert alone["links"] == [0, 0] and alone["root"] == [100, 101]


def test_cell_holds_little_beside_its_intersections():
    sets = [{*range(40), 1000 + k} for k in range(2600)]
    t = cell(sets, [k % 2 for k in range(2600)], 0, 1)
    tracemalloc.start()
    out = ngram_join._cell(80)(None, t)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.column("links").to_pylist() == [1300] * 2600 and len(set(out.column("root").to_pylist())) == 1
    assert peak < 80e6  # some 250 MB with all pairs of both blocks at once


def test_shared_tokens_move_once_and_sets_stay(spark, monkeypatch):
    kept = []
    for name in ("materialize", "materialize_bucketed"):
        old = getattr(ngram_join, name)
        monkeypatch.setattr(ngram_join, name, lambda df, name, *a, old=old, **b: (kept.append(name), old(df, name, *a, **b))[1])
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join([*base[:50], f"x{k}"]) for k in range(6)] + ["a b c d e f", None]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == {**{k: (0, 5) for k in range(6)}, 6: (6, 0), 7: (7, 0)}
    assert "token-sets" in kept and not {"shared-tokens", "prefix-edges"} & set(kept)

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        postings = spark.createDataFrame([(1, 5, 0, False)], "token long, sid long, salt tinyint, rest boolean")
        classes = spark.createDataFrame([(5, 5, 2)], "sid long, n long, m long")
        plan = ngram_join.rarest_prefixes(postings, classes, 80)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 3  # postings by token, shared ones and classes by class


def test_texts_that_share_nothing_are_read_once(spark):
    root = Path(session._scratch_root(spark).removeprefix("file:"))
    before, read = {*root.glob("shingle-sets-*")}, spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(30))) for k in range(8)], "doc_id long, text string")
    found = ngram_join.near_duplicates(docs.mapInArrow(watched, docs.schema))
    assert sorted(map(tuple, found.collect())) == [(k, 26, k, 0) for k in range(8)]
    assert read.value == 8 and {*root.glob("shingle-sets-*")} == before


def test_tokens_become_postings_in_pieces():
    sets = [[1, 2, 3], [4], list(range(9)), [5, 6]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4), pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["sid", "tokens"])
    parts = [p.column("tokens").to_pylist() for p in ngram_join.pieces(batch.slice(1), 3)]
    assert parts == [[[4]], [list(range(9))], [[5, 6]]] and [len(p) for p in ngram_join.pieces(batch, 4)] == [2, 1, 1]


def test_components_of_links_alone(spark):
    links = lambda rows: spark.createDataFrame(rows, "src long, dst long")
    rows = {tuple(r) for r in connected_components(None, links([(3, 2), (2, 9), (2, 3), (7, 7), (5, 6)])).collect()}
    assert rows == {(2, 2), (3, 2), (9, 2), (5, 5), (6, 5)}
    assert connected_components(None, links([(7, 7)])).collect() == []


def test_a_task_of_decontamination_has_one_python_worker(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (None, "d")], "doc_id long, text string")
    found = decontaminate.contamination(docs, spark.createDataFrame([(1, "b c")], "item_id long, text string"))
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {(r["doc_id"], r["n_words"], r["n_hit"]) for r in found.collect()} == {(1, 3, 2), (2, 0, 0), (None, 1, 0)}


def test_new_pieces_are_encoded_without_line_feeds():
    encode = token_store.Encoder(tokenizer_path())
    tokenizer, sent = encode.tokenizer, []

    class Watched:
        def encode_batch_fast(self, texts, **options):
            sent.extend(texts)
            return tokenizer.encode_batch_fast(texts, **options)

        def encode(self, text, **options):
            return tokenizer.encode(text, **options)

    encode.tokenizer = Watched()
    texts = ["one two, three. $$$ don't 's", "naïve Ġa Ġ 日本 語 1 22", " led by a space", "a\x00b \x01 c", "word"]
    assert encode(texts) == [array("I", tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    assert sent and not any("\n " in t for t in sent)


def test_bodies_are_encoded_once_whatever_their_punctuation():
    encode = token_store.Encoder(tokenizer_path())
    tokenizer, sent = encode.tokenizer, []

    class Watched:
        def encode_batch_fast(self, texts, **options):
            sent.extend(texts)
            return tokenizer.encode_batch_fast(texts, **options)

        def encode(self, text, **options):
            return tokenizer.encode(text, **options)

    encode.tokenizer = Watched()
    texts = ["one two", "one, two. one... two\none!", "it's 5' x€. ²! ½, 日. naïve, café's; ''s '' !", "", "\n\none,\ntwo", "a  b", "two,\n", "x\ty."]
    assert encode(texts) == [array("I", tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    assert " ".join(sent).count("two") <= 2 and "two." not in " ".join(sent)  # once led by a space, once by a line feed


def test_texts_are_not_dealt_out_because_others_leak(spark):
    rows = spark.createDataFrame([(i % 50 - 9, f"t{i % 60}") for i in range(120)], "id long, row string")
    ids = spark.createDataFrame([(i,) for i in (-9, 0, 7, 40, 99)], "id long")
    want = sorted((r["id"], r["row"]) for r in rows.collect() if r["id"] not in (-9, 0, 7, 40))
    for bits in (1, 16, 1 << 15, 1 << 23):
        assert sorted((r["id"], r["row"]) for r in corpus_pipeline.without(rows, ids, bits).collect()) == want
    assert corpus_pipeline.without(rows, ids.limit(0)).count() == rows.count()
    # Of the two parts, the rows whose bit is not set meet the bits only, which go to every task.
    parts = corpus_pipeline.without(rows, ids)._jdf.queryExecution().sparkPlan().toString().split("LeftAnti")
    assert len(parts) == 2 and "Join" in parts[0] and "SortMergeJoin" not in parts[0].rpartition("\n")[0]


def test_postings_go_once_words_and_hits_are_stored(spark):
    root = Path(session._scratch_root(spark).removeprefix("file:"))
    before = {*root.glob("postings-*")}
    docs = spark.createDataFrame([(1, "a b c"), (2, "x")], "doc_id long, text string")
    found = decontaminate.contamination(docs, spark.createDataFrame([(1, "b c")], "item_id long, text string"))
    assert {*root.glob("postings-*")} == before and [*root.glob("document-words-*")]
    assert {(r["doc_id"], r["n_hit"]) for r in found.collect()} == {(1, 2), (2, 0)}
