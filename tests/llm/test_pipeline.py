"""Each stage of the pipeline alone: nulls, empty and long texts, ties, repeated rows, no rows, clashing columns."""

from __future__ import annotations

import pytest

import corpus_pipeline as cp
from tests.llm.test_operators import awkward

SF = "/root/testdata/sf0.001"
STAGES = dict(cp.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    """The documents of the smallest table and awkward ones, with columns that stages use themselves."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(100_000 + i, t, "en", "odd", len(t or "")) for i, t in awkward()]
    odd += [(None, "no id one two three", None, None, None)] * 2 + [(100_008, awkward()[5][1], "en", "odd", 7)]
    rows = table.unionByName(spark.createDataFrame(odd, table.schema))
    return rows.selectExpr("*", "'k' AS kept", "'c' AS component_id", "1 AS h", "'s' AS score", "'p' AS piece", "source AS key")


def fates(before, after):
    ids = {r.doc_id for r in after.select("doc_id").collect()}
    return {r.doc_id: r.doc_id in ids for r in before.select("doc_id").collect()}


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES[:-1]])
def test_stage_keeps_the_columns_and_takes_no_rows(spark, docs, name):
    out = STAGES[name](spark, docs, SF)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert STAGES[name](spark, docs.limit(0), SF).count() == 0


def test_toxicity_keeps_texts_without_words(spark, docs):
    out = STAGES["toxicity"](spark, docs, SF)
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()}
    kept = fates(docs, out)
    gone = {i for i, k in kept.items() if not k}
    assert all(kept[100_003 + i] for i in range(3)) and kept[None]  # null, empty and blank texts
    assert len(gone & clean) <= 0.05 * len(clean)


def test_language_drops_texts_without_letters(spark, docs):
    kept = fates(docs, STAGES["language_id"](spark, docs, SF))
    assert not any(kept[100_003 + i] for i in range(3))
    assert sum(k for i, k in kept.items() if i is not None and i < 100_000) > 0.8 * sum(
        i is not None and i < 100_000 for i in kept)


def test_near_dedup_keeps_one_of_each_group(spark, docs):
    out = STAGES["near_dedup"](spark, docs, SF)
    kept = fates(docs, out)
    texts = dict(awkward())
    assert kept[100_010] and not kept[100_011] and not kept[100_012]  # the same prose, then in capitals
    assert all(kept[100_000 + i] for i in range(3, 6)) and texts[3] is None
    assert out.where("doc_id IS NULL").count() == 2
    assert out.where("doc_id = 100008").count() == 2


def test_substring_dedup_cuts_what_is_found_before(spark, docs):
    out = {r.doc_id: r for r in STAGES["substring_dedup"](spark, docs, SF).collect()}
    texts = {100_000 + i: t for i, t in awkward()}
    assert out[100_003].text is None and out[100_004].text == ""
    assert 100_011 not in out and 100_022 not in out  # a copy of prose, and the passage alone
    assert all(out[100_000 + i].text == texts[100_000 + i] for i in (10, 12, 14, 17, 19, 20))
    assert (out[100_015].text, out[100_015].n_chars) == ("head", 4)  # a head before the passage
    assert out[100_018].text == "x"  # behind a long text that another document has too


def test_packing_of_every_row(spark, docs):
    out = STAGES["packing"](spark, docs, SF)
    assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert out.where("doc_id = 100003").select("length").first()[0] == 1
    assert out.groupBy("sequence_id").agg({"length": "sum"}).agg({"sum(length)": "max"}).first()[0] <= 2048
    assert STAGES["packing"](spark, docs.limit(0), SF).count() == 0


def test_stages_are_in_order():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "language_id", "near_dedup", "substring_dedup", "packing"]
