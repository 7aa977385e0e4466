"""The stages of the corpus pipeline, each against its operator's own verdicts."""

from collections import Counter

import pytest

import corpus_pipeline
from quizlens.llm import dedup, quality, secrets


@pytest.fixture(scope="module")
def steps(spark, data):
    docs, out = spark.read.parquet(f"{data}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, data).cache()
        out.append((name, docs, after))
        docs = after
    return out


def test_columns_stay(steps):
    for _, before, after in steps[:-1]:
        assert after.columns == before.columns and after.count() > 0


def test_languages_and_quality(steps):
    assert steps[0][2].count() == steps[0][1].count()       # every text of the table has a language
    kept = {r["doc_id"] for r in quality.judge(steps[1][1]).where("kept").collect()}
    assert {r["doc_id"] for r in steps[1][2].collect()} == kept


def test_one_of_each_group(steps):
    judged = dedup.near_duplicates(steps[2][1]).collect()
    assert sorted(r["doc_id"] for r in steps[2][2].collect()) == sorted({r["component_id"] for r in judged})


def test_no_base_secret_stays(steps):
    assert not any(secrets.base_spans(r["text"]) for r in steps[3][2].collect())
    assert steps[3][2].count() == steps[3][1].count()


def test_all_tokens_are_packed(steps):
    rows = steps[4][2].collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in steps[4][1].collect()}
    per = {}
    for r in rows:
        per.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    for parts in per.values():
        at = 0
        for start, length, _ in sorted(parts):
            assert start == at
            at += length
        assert at == parts[0][2]


def test_stages_take_odd_tables(spark, data, frame):
    """Nulls, empty and very long texts, repeated rows and ids, and clashing columns go through every stage."""
    from tests.llm.conftest import LONG, ODD

    prose = " ".join(["the house and the garden of my father were old, and we went there to see it"] * 3)
    docs = frame(ODD + [(20 + i, f"{prose} {i} " + " ".join(f"word{i * 50 + k}" for k in range(60))) for i in range(6)])
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns, name
        have, had = (Counter((r["doc_id"], r["n_chars"]) for r in d.collect()) for d in (out, docs))
        assert not have - had, name
        if name == "secret scan":
            assert have == had
        if name == "near duplicates":
            assert have[11, None] == 1 and have[11, 25] == 1
        if name == "quality rules":
            assert (None, 29) not in have and sum(have.values()) >= 1
    assert LONG in {r["text"] for r in corpus_pipeline.STAGES[2][1](spark, docs, data).collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data).groupBy("doc_id").count().collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in kept.select("doc_id").collect()}


def test_stages_take_empty_tables(spark, data, empty):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, data)
        assert out.count() == 0, name
