"""Quality, toxicity and language: held-out accuracy on the small tables, and the odd cases."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import language, quality, registry, toxicity
from tidegauge.llm.batches import ready
from tidegauge.llm.quality import held_out

SF = "/root/testdata/sf0.01"
ODD = [(1, None, None, 1), (2, "", "en", 1), (None, "the and the", "en", 1), (4, "123 !!", None, 1), (5, "x " * 200000, "en", 1), (6, "the", "en", 1), (6, "the", "en", 1)]
COLUMNS = "doc_id long, text string, lang string, score int"


@pytest.fixture(scope="module")
def queries():
    return registry.collect()[0]


@pytest.fixture(scope="module")
def odd(spark):
    return ready(spark).createDataFrame(ODD, COLUMNS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_on_held_out_rows(spark, queries, labels):
    got = queries["op9_quality_discriminant"](spark, SF)
    assert got.count() == 1000 and set(got.columns) == {"doc_id", "held_out", "score", "predicted"}
    seen = got.join(labels, "doc_id").where("held_out").agg(F.count(F.lit(1)), F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()
    assert seen[0] > 50 and seen[1] >= 0.97


def test_toxicity_on_held_out_rows(spark, queries, labels):
    got = queries["op2_toxicity_ordinal"](spark, SF)
    assert got.count() == 1000
    rows = got.withColumnRenamed("toxic", "found").join(labels, "doc_id").where(held_out()).select("found", "toxic", "severity").collect()
    assert sum(r.found == r.toxic for r in rows) / len(rows) >= 0.93
    assert np.mean([r.severity for r in rows if r.toxic]) > 5 * np.mean([r.severity for r in rows if not r.toxic])
    assert sum(r.found for r in rows if not r.toxic) <= 1


def test_language_on_held_out_rows(spark, queries):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries["op6_language_filters"](spark, SF).join(docs, "doc_id")
    assert got.count() == 1000
    assert got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] >= 0.97
    assert got.where("score < 0 or score > 1").count() == 0


def test_odd_rows(spark, odd, labels):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", F.lit(0).alias("score"))
    everything = docs.union(odd)
    scored = quality.score_quality(everything, labels)
    assert scored.count() == 1007 and scored.where("score is null or isnan(score)").count() == 0
    assert quality.good(everything, labels).columns == everything.columns
    toxic = toxicity.score_toxicity(odd, labels, learn=docs)
    assert toxic.count() == len(ODD) and toxic.where("severity is null or toxic = 1").count() == 0
    assert toxicity.mild(everything, labels).count() >= 850
    langs = {(r.doc_id, r.lang_pred, r.score > 0) for r in language.identify(odd, docs).collect()}
    assert langs == {(1, "und", False), (2, "und", False), (None, "en", True), (4, "und", False), (5, next(x for d, x, _ in langs if d == 5), next(s for d, _, s in langs if d == 5)), (6, "en", True)}
    assert language.identify(odd.limit(0), odd.limit(0)).count() == 0


def test_nothing_to_learn_from(spark, odd, labels):
    none = labels.where("false")
    assert {r.score for r in quality.score_quality(odd, none).collect()} == {0.5}
    assert {r.severity for r in toxicity.score_toxicity(odd, none).collect()} == {0.0}
    assert {r.lang_pred for r in language.identify(odd, odd.where("false")).collect()} == {"und"}


def test_discriminant_is_the_log_density_ratio(spark):
    rng = np.random.default_rng(1)
    d = len(quality.STATISTICS)
    parts = [rng.normal(size=(300, d)) * (1 + k) + k for k in (0, 1)]
    rows = ready(spark).createDataFrame([(r.tolist(), k) for k, p in enumerate(parts) for r in p], "x array<double>, label int")
    model = quality.fitted(rows, "label", to_pooled=0.0, to_sphere=0.0)
    probe = rng.normal(size=(20, d))
    log = []
    for p in parts:
        cov = np.cov(p.T, bias=True)
        away = probe - p.mean(0)
        log.append(-0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away) - 0.5 * np.linalg.slogdet(cov)[1])
    want = 1 / (1 + np.exp(-np.clip((log[1] - log[0]) / quality.SOFTER, -30, 30)))
    assert np.allclose(model.scores(probe), want, atol=1e-6)


def test_statistics_of_known_texts():
    x = quality.statistics(pa.array(["a a b", "", None, "ÉÉ !! AB", "one\ntwo"]))
    at = {k: i for i, k in enumerate(quality.STATISTICS)}
    assert np.isclose(x[0, at["words"]], np.log(4)) and np.isclose(x[0, at["repeats"]], np.sqrt(1 / 3))
    assert not x[1].any() and not x[2].any()
    assert np.isclose(x[3, at["bare"]], np.sqrt(1 / 3)) and np.isclose(x[3, at["capitals"]], np.sqrt(2 / 4))
    assert np.isclose(x[4, at["lines"]], np.sqrt(1 / 2))


def test_ordinal_gradient_descends_to_the_likelihood_of_counts():
    grades = np.repeat([0, 1, 2, 3], [50, 25, 15, 10])
    none = np.zeros(0, np.int64)
    _, theta = toxicity.descend(none, none, np.zeros(0), grades, 0, steps=800)
    assert np.allclose(1 / (1 + np.exp(-theta)), [0.5, 0.75, 0.9], atol=0.01)
    rows = np.arange(100)
    w, theta = toxicity.descend(rows, np.zeros(100, np.int64), grades.astype(float), grades, 1)
    assert w[0] > 1 and (np.diff(theta) > 0).all()


def test_filters_hold_what_they_were_given(spark):
    docs = ready(spark).createDataFrame([(i, t, lang) for i in range(40) for lang, t in (("aa", "walla balla talla"), ("bb", "krim prim trim"))], "doc_id long, text string, lang string")
    filters = language.fitted(docs, rows_log2=12)
    langs, scores = filters.found(pa.array(["balla", "prim trim", "walla krim walla"]))
    assert langs == ["aa", "bb", "aa"] and scores[2] < scores[0]
    many = [(i, f"q{chr(97 + i // 26)}{chr(97 + i % 26)}zz " * 5, f"l{i:03d}") for i in range(130)]  # more languages than bits in a word
    filters = language.fitted(spark.createDataFrame(many, "doc_id long, text string, lang string"), rows_log2=14)
    assert filters.rows.shape[1] == 3 and filters.found(pa.array([t for _, t, _ in many]))[0] == [lang for *_, lang in many]
