"""Registered text queries agree with their SQL."""

import pytest

from compare import connect, difference
from fundtrail.llm import queries


@pytest.fixture(scope="module")
def duck():
    return connect("/root/testdata/sf0.001")


def test_one_query_for_each_operator():
    names = list(queries.queries())
    assert sorted(int(n.split("_")[0][2:]) for n in names if n.startswith("op")) == list(range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.checks()))
def test_query_agrees_with_sql(spark, duck, name):
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    assert difference(queries.queries()[name](spark, "/root/testdata/sf0.001"), duck, queries.checks()[name]) is None


def test_held_out_language_accuracy(spark, sf_dir):
    found = queries.queries()["op7_language_spans"](spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    judged = found.where("held_out").join(docs.where("lang is not null"), "doc_id")
    assert judged.where("lang = lang_pred").count() >= 0.97 * judged.count() > 0
