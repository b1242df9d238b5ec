"""Language, quality and toxicity: held-out accuracy on the given tables, and defined results on odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voidscope.llm import langid, quality, registry, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(1, None, None), (2, "", 0), (3, " \n\t", 3), (4, "12345 !!! ###", 13), (5, "the and of " * 50_000, None),
       (6, "of the and with", 15), (6, "of the and with", 15), (None, "of the and with", -4)]


def odd(spark):
    return spark.createDataFrame([(*r, "x", 0.5, "de") for r in ODD], "doc_id long, text string, n_chars long, lang_pred string, score double, lang string")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_language(spark, documents):
    found = registry.op2_langid(spark, SF).join(documents, "doc_id").filter("held_out").toPandas()
    assert len(found) > 200 and (found.lang == found.lang_pred).mean() > 0.98
    assert found.score.between(0, 1).all()
    total = registry.op2_langid(spark, SF)
    assert total.count() == documents.count()
    assert dict(total.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}


def test_language_of_odd_rows(spark, documents):
    model = langid.learn(documents.limit(200))
    rows = langid.predict(odd(spark), model).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    for i in (1, 2, 3, 4):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert by[5].lang_pred == by[6].lang_pred == by[None].lang_pred == "en"
    empty = langid.learn(documents.filter("false"))
    assert {r.lang_pred for r in langid.predict(odd(spark), empty).collect()} == {"und"}
    assert langid.predict(documents.filter("false"), model).count() == 0


def test_numerals_are_no_letters(spark, documents):
    model = langid.learn(documents.limit(200))
    rows = spark.createDataFrame([(1, "½"), (2, "²³ ½"), (3, "Ⅷ ①"), (4, "½ und ein Wort")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred == "und" for r in langid.predict(rows, model).collect()} == {1: True, 2: True, 3: True, 4: False}


def test_kernel_is_the_cosine_of_presence_sets():
    sets = [langid.presence(t) for t in ("abcab", "abcab abcab", "zzz", "")]
    x = langid.matrix(sets).astype(float)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            kernel = sum(
                w * len(np.intersect1d(p, q)) / np.sqrt(len(p) * len(q)) if len(p) and len(q) else 0.0
                for (_, _, w), p, q in zip(langid.SPECTRUM, a, b))
            assert abs(x[i] @ x[j] - kernel) < 1e-5


def test_presence_of_a_long_text_is_taken_in_parts(monkeypatch):
    text = "Ein ganz gewöhnlicher Satz, der lang genug ist. " * 20
    whole = langid.presence(text)
    monkeypatch.setattr(langid, "_PIECE", 13)
    assert all((a == b).all() for a, b in zip(whole, langid.presence(text)))


def test_quality(spark, documents, labels):
    found = registry.op3_quality(spark, SF)
    assert found.count() == documents.count()
    rows = found.join(labels, "doc_id").filter("held_out").toPandas()
    assert (rows.predicted == rows.quality).mean() > 0.93 and rows.score.between(0, 1).all()
    assert ((rows.score >= 0.5).astype(int) == rows.predicted).all()


def test_quality_of_odd_rows(spark, documents, labels):
    model = quality.learn(documents, labels.select("doc_id", F.col("quality").alias("label")))
    rows = quality.score(odd(spark), model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    untrained = quality.learn(documents, labels.filter("false").select("doc_id", F.col("quality").alias("label")))
    assert {r.score for r in quality.score(odd(spark), untrained).collect()} == {0.5}
    assert quality.score(documents.filter("false"), model).count() == 0
    assert quality.score(documents.select("doc_id", "text").limit(3), model).count() == 3


def test_interactions_equal_the_sum_over_pairs():
    random = np.random.default_rng(0)
    model = quality.fit([], np.zeros(0))
    model.weights, model.factors = random.normal(size=quality.INPUTS), random.normal(size=(quality.INPUTS, quality.FACTORS))
    numbers, values, sizes = model.rows([([3, 9, 77], np.arange(quality.STATISTICS + quality.METADATA, dtype=float)), ([], np.ones(quality.STATISTICS + quality.METADATA))])
    start = 0
    for size, margin in zip(sizes, model.margins(numbers, values, sizes)):
        i, x = numbers[start:start + size], values[start:start + size]
        slow = model.weights[i] @ x + sum(
            model.factors[i[a]] @ model.factors[i[b]] * x[a] * x[b] for a in range(size) for b in range(a))
        assert abs(margin - slow) < 1e-8
        start += size


def test_toxicity(spark, documents, labels):
    found = registry.op10_toxicity(spark, SF)
    assert found.count() == documents.count()
    rows = found.join(labels, "doc_id").filter("held_out").toPandas()
    assert (rows.predicted == rows.toxic).mean() > 0.95
    assert rows[rows.toxic == 0].predicted.mean() < 0.02  # clean documents stay


def test_toxicity_of_odd_rows(spark, documents, labels):
    model = toxicity.learn(documents, labels.select("doc_id", F.col("toxic").alias("label")))
    rows = toxicity.score(odd(spark), model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert {r.predicted for r in rows if r.doc_id in (1, 2, 3, 4)} == {0}
    blank = toxicity.learn(documents.filter("false"), labels.select("doc_id", F.col("toxic").alias("label")))
    assert {r.predicted for r in toxicity.score(odd(spark), blank).collect()} == {0}
    insult = spark.createDataFrame([(1, "you are a pathetic idiot and worthless scum")], "doc_id long, text string")
    assert toxicity.score(insult, model).first().predicted == 1


def test_label_model_counts_copied_voters_once():
    random = np.random.default_rng(4)
    truth = random.random(4000) < 0.3
    good = np.stack([np.where(truth, random.random(4000) < 0.8, random.random(4000) < 0.05) for _ in range(3)], axis=1)
    noise = random.random(4000) < 0.3
    votes = np.concatenate([good, np.repeat(noise[:, None], 8, axis=1)], axis=1)
    labels = np.where(np.arange(4000) < 400, truth.astype(float), np.nan)
    posterior = toxicity.label_model(votes, labels)
    assert ((posterior > 0.5) == truth)[400:].mean() > 0.93
