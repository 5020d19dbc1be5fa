"""The corpus pipeline, stage by stage against brute force and as a whole."""

from collections import Counter

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from fundtrail.llm.queries import tokenizer_path
from test_small_cases import SPACE_WORD, brute_components, brute_leaks, brute_targets, prose

EN = "the house and the garden were quite old and the door was shut "
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, copies int, row string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    base = EN + prose(1, 80)
    texts = [EN * (1 + i % 3) + prose(100 + i, 30 + i) for i in range(30)]
    texts += [base, base, base.replace("w1", "w2", 1), None, "", "12 34", EN + prose(50, 14), EN + "word " * 300]
    rows = [(i if i != 4 else None, t, "en" if t else None, f"s{i % 3}" if i % 7 else None, len(t or ""), "x", 5, "y") for i, t in enumerate(texts)]
    rows.append(rows[5])
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(root / "documents.parquet"))
    spark.createDataFrame([(1, prose(50, 14)), (2, None)], "item_id long, text string").write.parquet(str(root / "benchmark.parquet"))
    return str(root), rows


def test_stages(spark, folder):
    sf_dir, rows = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    language, near, leaks, mix, tokens = (f for _, f in corpus_pipeline.STAGES)
    both = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())

    docs = language(spark, docs, sf_dir)
    assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert both(docs) == Counter((r[0], r[1]) for r in rows)

    docs = near(spark, docs.cache(), sf_dir)
    keep = {d for d, _, lowest, _ in brute_components([(r[0], r[1]) for r in rows]) if d == lowest}
    rows = list({(r[0], r[1]): r for r in rows if r[0] in keep}.values())
    assert both(docs) == Counter((r[0], r[1]) for r in rows) and {30} == keep & {30, 31, 32}

    docs = leaks(spark, docs.cache(), sf_dir)
    clean = [hit == 0 for _, hit, _ in brute_leaks([r[1] for r in rows], [(1, prose(50, 14))])]
    assert clean.count(False) == 1
    rows = [r for r, c in zip(rows, clean, strict=True) if c]
    assert both(docs) == Counter((r[0], r[1]) for r in rows)

    docs = mix(spark, docs.cache(), sf_dir)
    size = lambda t: len(SPACE_WORD.findall(t))
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    for r in docs.collect():
        taken[r["source"]] += size(r["text"])
    targets = brute_targets(sizes)
    assert all(abs(taken[s] - targets[s]) <= 60 for s in sizes) and max(both(docs).values()) <= 2

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    wanted = Counter((r["doc_id"], len(tok.encode(r["text"], add_special_tokens=False).ids) + 1) for r in docs.collect())
    assert Counter((r["doc_id"], r["n_tokens"]) for r in tokens(spark, docs, sf_dir).collect()) == wanted


def test_texts_in_three_languages_stay(spark, tmp_path):
    prose_of = {
        "en": EN, "de": "das haus und der garten waren schon sehr alt und die kleine tür war geschlossen ",
        "fr": "la maison et le jardin étaient assez vieux et cette porte était toujours fermée ",
    }
    rows = [(n, t * (1 + n % 3), lang) for n, (lang, t) in enumerate([*prose_of.items()] * 8)]
    mixed = "".join(prose_of[x] for x in ("en", "de", "fr")) * 3
    docs = spark.createDataFrame([*rows, (100, mixed, None), (101, "12 34", None)], "doc_id long, text string, lang string")
    model = corpus_pipeline.langid.train(docs.where(corpus_pipeline.langid.learnable(F.col("doc_id"), F.col("lang"))))
    score = {r["id"]: r["score"] for r in corpus_pipeline.langid.identify(docs, model).selectExpr("row.doc_id id", "score").collect()}
    assert 0 < score[100] < 0.4
    kept = {r["doc_id"] for r in corpus_pipeline.language_stage(spark, docs, str(tmp_path)).collect()}
    assert kept == {r[0] for r in rows} | {100}


def test_run_joins_the_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder[0]).collect()
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in rows)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert {33, 34, 35, 36} & {r["doc_id"] for r in rows} == set()


def test_nothing_in_nothing_out(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs_out = stage(spark, docs, folder[0])
        assert docs_out.collect() == []


def test_near_duplicates_are_told_apart_by_row(spark):
    """Near copies that share an id leave one row; wordless rows are linked with nothing, repeated or not."""
    text = prose(60, 80)
    near = text.replace(text.split()[-1], "other")
    rows = [(7, text), (7, near), (7, text), (9, near), (None, text), (None, prose(61, 80)), (5, ""), (5, ""), (None, None), (None, None), (8, " \t"), (3, prose(62, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    got = Counter((r["doc_id"], r["text"]) for r in stage(spark, docs, "").collect())
    linked = [k for k in got if k[1] in (text, near)]
    assert len(linked) == 1 and linked[0][0] == 7 and got[linked[0]] == 1
    rest = Counter({(None, prose(61, 80)): 1, (5, ""): 2, (None, None): 2, (8, " \t"): 1, (3, prose(62, 40)): 1})
    assert got - Counter(linked) == rest
