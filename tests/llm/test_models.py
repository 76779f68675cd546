"""The two learnt operators: held-out accuracy, what they learn from, and odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import language, quality

from . import brute

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_on_held_out_rows(documents, labels):
    got = quality.scored(documents, labels)
    rows = got.join(labels, "doc_id").collect()
    assert all(r.held_out == brute.held_out(r.doc_id) for r in rows)
    assert all((r.predicted == 1) == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 50
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert all(r.predicted for r in held if r.quality == 1)


def test_quality_learns_from_no_held_out_label_and_no_negative(documents, labels):
    flipped = labels.withColumn("quality", F.when(F.expr("pmod(crc32(cast(doc_id as string)), 4) = 2"), 1 - F.col("quality")).otherwise(F.col("quality")))
    only_good = labels.where("quality = 1")
    weights = [quality.train(documents, x)["weights"] for x in (labels, flipped, only_good)]
    assert np.array_equal(weights[0], weights[1]) and np.array_equal(weights[0], weights[2])
    other = documents.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("?"))
    assert np.array_equal(weights[0], quality.train(other, labels)["weights"])


def test_class_prior_and_risk():
    rng = np.random.default_rng(2)
    long = np.full((3000, len(quality.KINDS) + 3), np.log1p(1000))  # texts of many words
    good, bad = (np.concatenate([long, rng.normal(mean, 1, (3000, 3))], axis=1) for mean in (0, 4))
    unlabelled = np.concatenate([good[1500:2700], bad[:400]])
    model = quality.fit_positive_unlabelled(good[:1500], unlabelled)
    assert abs(model["prior"] - 0.75) < 0.06
    score = lambda x: quality._sigmoid(quality._expanded(x, model) @ model["weights"])
    assert (score(good[2700:]) > 0.5).mean() > 0.95 and (score(bad[400:]) < 0.5).mean() > 0.95


def test_quality_of_odd_rows(spark, odd, nothing, labels):
    some = spark.createDataFrame([(0, 1, 0), (1, 1, None), (7, None, 0), (None, 1, 0), (99, 1, 0), (0, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.scored(odd, some).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 12}) == 1
    assert all(r.score == 1 for r in quality.scored(odd, some.limit(0)).collect())
    assert quality.scored(nothing, labels).count() == 0
    kept = quality.without_poor(odd, some)
    assert kept.schema == odd.schema


def test_language_on_held_out_rows(documents):
    rows = language.identified(documents).join(documents, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == brute.held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97


def test_language_learns_from_text_and_lang_alone(documents):
    model = language.train(documents)
    changed = documents.withColumn("source", F.lit("?")).withColumn("lang", F.when(F.expr("pmod(crc32(cast(doc_id as string)), 4) = 2"), "zz").otherwise(F.col("lang")))
    assert np.array_equal(model["weights"], language.train(changed)["weights"])


@pytest.mark.parametrize("classes", [1, 2, 3, 4, 5, 6, 12, 40])
def test_codewords_are_apart(classes):
    code = language.codewords(classes)
    apart = [(code[i] != code[j]).sum() for i in range(classes) for j in range(i)]
    assert code.shape[0] == classes and set(np.unique(code)) <= {-1.0, 1.0}
    if classes > 2:
        assert min(apart) >= 2
    assert all(len(set(c)) == 2 for c in code.T) or classes == 1


def test_a_wrong_bit_is_corrected():
    code = language.codewords(5)
    model = {"code": code, "trust": np.full(code.shape, 1 / code.shape[1]), "weights": np.concatenate([np.eye(code.shape[1]), np.zeros((1, code.shape[1]))])}
    for i, word in enumerate(code):
        for bit in range(code.shape[1]):
            sent = 3 * word
            sent[bit] *= -1
            assert language.decode(sent[None, :], model)[0][0] == i


def test_languages_of_odd_rows(odd, nothing):
    got = language.identified(odd).collect()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert len(got) == odd.count()
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].ambiguous for i in (2, 3, 4))
    assert all(r.lang_pred == "en" for i, r in by.items() if i not in (2, 3, 4))
    assert {r.lang_pred for r in language.identified(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identified(nothing).count() == 0


def test_und_without_letters(spark, documents):
    rows = [(10**6, "123 456 !!", "en"), (10**6 + 1, "ñ", "es"), (10**6 + 2, "東京", "ja")]
    got = language.identified(documents.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string"))).where("doc_id >= 1000000").collect()
    assert [r.lang_pred == "und" for r in sorted(got)] == [True, False, False]
