"""The pipeline, stage by stage, on the smallest tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_near_duplicates import expected
from tidegauge.llm import decontamination, quality, toxicity
from tidegauge.llm.batches import ready

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    """Input and output of every stage, with odd rows among the documents."""
    folder = tmp_path_factory.mktemp("stages")
    docs = ready(spark).read.parquet(f"{SF}/documents.parquet")
    first = docs.where("doc_id = 5").first()
    odd = [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (None, first.text, "en", "s", 0), (902, first.text, None, None, None), (5, first.text, first.lang, first.source, first.n_chars)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(str(folder / str(i)))
        out.append(spark.read.parquet(str(folder / str(i))))
    return out


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)


def test_stages_keep_the_columns(outputs):
    assert [len(o.columns) for o in outputs[:-1]] == [5] * 5
    assert all(o.columns == outputs[0].columns for o in outputs[:-1])


def test_quality_and_toxicity_keep_what_the_operators_accept(spark, outputs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert ids(outputs[1]) == ids(quality.score_quality(outputs[0], labels).where("predicted = 1"))
    assert ids(outputs[2]) == ids(toxicity.score_toxicity(outputs[1], labels).where("toxic = 0"))


def test_one_document_of_each_group_stays(outputs):
    before = [(r.doc_id, r.text) for r in outputs[2].collect()]
    want = {d for d, (_, c) in expected([x for x in before if x[0] is not None]).items() if c == d}
    after = ids(outputs[3])
    assert len(after) == len(set(after)) and set(after) - {None} == want
    assert (None in after) == (None in {d for d, _ in before})


def test_no_item_is_left_and_clean_documents_stay(spark, outputs):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    leaked = {r.doc_id for r in decontamination.find_leaks(outputs[3], benchmark).collect()}
    assert set(ids(outputs[4])) == {d for d in ids(outputs[3]) if d not in leaked}


def test_texts_come_back(outputs):
    assert ids(outputs[5]) == ids(outputs[4])
    assert outputs[5].where("NOT restored OR n_tokens <> size(piece_ids)").count() == 0
    assert outputs[5].agg(F.sum("n_tokens")).first()[0] > 1000
