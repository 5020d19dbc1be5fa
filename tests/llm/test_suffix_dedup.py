import hashlib
from collections import Counter

from fundtrail.llm import suffix_dedup
from fundtrail.llm.queries import queries
from fundtrail.llm.suffix_dedup import prefix_intervals, remove_repeats


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts, length=200, k=64):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = remove_repeats(docs, length, k).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == brute(texts, length)


def test_prefix_intervals_of_a_suffix_array():
    # banana: a, ana, anana, banana, na, nana
    assert sorted(prefix_intervals([0, 1, 3, 0, 0, 2])) == [(0, 0, 5), (1, 0, 2), (2, 4, 5), (3, 1, 2)]


def test_against_brute_force_on_small_windows(spark):
    import random

    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh ") for _ in range(400))
    texts = [None, "", "ab", base, base, base[:150] + "X" + base[151:], "é" * 90, "z" * 120, "q" + base[37:300] + "r"]
    for _ in range(25):
        t = list(base[rng.randrange(200) :])
        for _ in range(rng.randrange(6)):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        texts.append("".join(rng.choice("uvw ") for _ in range(rng.randrange(60))) + "".join(t))
    check(spark, texts, 40, 12)


def test_hot_anchors_are_settled_by_their_windows(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_BLOCKS", 3)
    import random

    rng = random.Random(6)
    common = "".join(rng.choice("abcdef") for _ in range(90))
    word = lambda n: "".join(rng.choice("ghijkl") for _ in range(n))
    check(spark, [word(rng.randrange(80)) + common + word(70) for _ in range(30)], 40, 12)


def test_equal_rows_repeat_each_other_and_extra_columns_are_left_alone(spark):
    text = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(120))
    docs = spark.createDataFrame([(1, text, "x"), (1, text, "y"), (None, "short", "z")], "doc_id long, text string, doc string")
    rows = {(r["doc_id"], r["n_removed"]) for r in remove_repeats(docs).collect()}
    assert rows == {(1, len(text)), (None, 0)}


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    found = {r["doc_id"]: tuple(r)[1:] for r in queries()["op1_suffix_repeats"](spark, sf_dir).collect()}
    wanted = brute([r["text"] for r in rows], 200)
    assert [found[r["doc_id"]] for r in rows] == wanted
    assert sum(w[1] for w in wanted) > 0
