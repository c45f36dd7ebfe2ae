"""Hashes do not depend on what else a batch holds."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidegauge.llm import batches, decontamination, ngram_join, toxicity
from tidegauge.llm.batches import ready

LONG = "z" * 5000
SF = "/root/testdata/sf0.01"


def _one_task(spark, rows, schema="doc_id long, text string"):
    return ready(spark).createDataFrame(rows, schema).coalesce(1)


def test_hash_beside_a_long_word():
    def hashed(*words):
        starts, lens, data = batches.packed([w.encode() for w in words])
        return batches.hashes(data, starts, starts + lens).tolist()

    short, full = ["hello", "a", "y" * 4096], ["y" * 4097, LONG, LONG[:-1] + "y"]
    assert hashed(*short, *full)[:3] == hashed(*short) == [hashed(w)[0] for w in short]
    assert len(set(hashed(*short, *full))) == 6
    alone = next(ngram_join.sets_of(pa.array(["a b c d e f"]), 5))
    assert np.array_equal(next(ngram_join.sets_of(pa.array(["a b c d e f", LONG]), 5)), alone)


def test_copy_beside_a_long_word(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = _one_task(spark, [(1, text), (2, "x " + LONG)]).union(spark.createDataFrame([(3, text), (4, "others here are of no use at all")], "doc_id long, text string"))
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4}


def test_passage_beside_a_long_word(spark):
    passage = " ".join(f"item{i}" for i in range(25))
    docs = _one_task(spark, [(1, f"before it {passage} and after"), (2, "x " + LONG)])
    benchmark = ready(spark).createDataFrame([(7, passage)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, benchmark).collect()] == [(1, 7)]
    assert [r.doc_id for r in decontamination.without_leaks(docs, benchmark).collect()] == [2]


def test_toxic_text_beside_a_long_word(spark):
    learn = ready(spark).read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    texts = [(r.doc_id, r.text) for r in learn.join(labels.where("toxic = 1"), "doc_id").orderBy(F.length("text")).limit(5).collect()]
    got = [{r.doc_id: (r.toxic, r.severity) for r in toxicity.score_toxicity(_one_task(spark, texts + more), labels, learn=learn).collect()} for more in ([], [(-1, LONG)])]
    assert got[1].pop(-1)[0] == 0
    assert got[0] == got[1] and any(found == 1 for found, _ in got[0].values())
