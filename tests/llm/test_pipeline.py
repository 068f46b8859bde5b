"""The corpus pipeline's stages, each against a plain computation on its own input."""

import pytest

import corpus_pipeline
from skerry.llm import near_dup, quality, secrets, toxicity
from skerry.llm._shared import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(materialize(stage(spark, seen[-1], SF), name))
    return seen


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def test_filters_follow_scores(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert ids(stages[1]) == ids(toxicity.score_toxicity(stages[0], labels).where("predicted = 0"))
    assert ids(stages[2]) == ids(quality.score_quality(stages[1], labels).where("predicted = 1"))
    assert ids(stages[3]) == ids(near_dup.near_duplicates(stages[2]).where("kept"))
    assert len(ids(stages[3])) > 0.6 * len(ids(stages[0]))


def test_secrets_are_gone(stages):
    before, after = ({r.doc_id: r for r in df.collect()} for df in stages[3:5])
    assert before.keys() == after.keys()
    for key, r in after.items():
        assert not secrets.base_spans(r.text) and r.n_chars == len(r.text)
        if not secrets.base_spans(before[key].text) and "[learned]" not in r.text:
            assert r.text == before[key].text


def test_packing_holds_every_document(stages):
    assert sorted({r.doc_id for r in stages[5].collect()}) == ids(stages[4])


def test_run(spark, stages):
    assert ids(corpus_pipeline.run(spark, SF)) == ids(stages[5])
