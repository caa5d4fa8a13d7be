"""Language, quality and toxicity models on held-out rows and odd texts."""

import random

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import langid, quality, toxicity

from .conftest import SCHEMA, make_docs, sentence


def test_languages(spark, odd_docs):
    docs = spark.createDataFrame(make_docs(300), SCHEMA)
    model = langid.fit_languages(docs)
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.95
    odd = langid.identify(odd_docs.withColumn("score", F.lit(1)), model).collect()
    assert len(odd) == odd_docs.count()
    assert {r.doc_id for r in odd if r.lang_pred == "und"} == {None, 1000, 1001, 1002, 1003}
    assert all(0 <= r.score <= 1 and (r.score == 0 or r.lang_pred != "und") for r in odd)


def test_no_languages(odd_docs, no_docs):
    model = langid.fit_languages(no_docs)
    assert langid.identify(odd_docs, model).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(no_docs, model).count() == 0


def test_one_language(spark):
    docs = spark.createDataFrame([(i, "some words", "en", "s", 0) for i in range(20)], SCHEMA)
    assert langid.identify(docs, langid.fit_languages(docs)).where("lang_pred = 'en'").count() == 20


def test_code_words_differ():
    for k in (2, 3, 4, 9):
        book = langid.code_words(k)
        assert (book.shape[1] - book @ book.T)[~np.eye(k, dtype=bool)].min() >= 8


def labelled(n, seed, bad):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = " ".join(sentence(rng, "en", rng.randint(4, 12)) for _ in range(rng.randint(2, 8)))
        flag = rng.random() < 0.3
        out.append((i, bad(rng, text) if flag else text, "en", "s", 0, int(flag)))
    return out


def test_quality(spark, odd_docs, no_docs):
    rows = labelled(600, 4, lambda rng, t: " ".join(w + rng.choice(["%%%", "$$$"]) for w in t.split()))
    docs = spark.createDataFrame(rows, SCHEMA + ", y int")
    labels = docs.select("doc_id", (1 - F.col("y")).alias("quality"))
    model = quality.fit_quality(docs.drop("y"), labels)
    got = quality.score_quality(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
    assert quality.score_quality(odd_docs, model).where("score between 0 and 1").count() == odd_docs.count()
    empty = quality.fit_quality(docs, labels.where("false"))
    assert quality.score_quality(odd_docs, empty).where("score = 0.5").count() == odd_docs.count()
    assert quality.score_quality(no_docs, model).count() == 0


def test_isotonic_is_monotone():
    rng = np.random.default_rng(1)
    x = rng.uniform(size=500)
    knots, values = quality.isotonic(x, (rng.uniform(size=500) < x).astype(float))
    assert (np.diff(knots) >= 0).all() and (np.diff(values) >= 0).all() and abs(np.interp(0.9, knots, values) - 0.9) < 0.15


def insult(rng, text):
    words = text.split()
    for _ in range(max(2, len(words) // 10)):
        words.insert(rng.randrange(len(words)), rng.choice(["moron", "zuxel", "zuxelan"]) + rng.choice(["", "th", "er"]))
    return " ".join(words)


def test_toxicity(spark, odd_docs, no_docs):
    docs = spark.createDataFrame(labelled(700, 9, insult), SCHEMA + ", y int")
    labels = docs.select("doc_id", F.col("y").alias("toxic"))
    model = toxicity.fit_toxicity(docs.drop("y"), labels)
    got = toxicity.score_toxicity(docs, model).join(docs.select("doc_id", "y", "text"), "doc_id").collect()
    assert np.mean([r.predicted == r.y for r in got if r.held_out]) > 0.95
    found = {r.text[s.start : s.end].strip(".") for r in got for s in r.spans}
    assert {"moron", "zuxel", "zuxelan", "zuxeler"} <= found
    odd = toxicity.score_toxicity(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert all(r.score == 0 for r in odd if r.doc_id in (1000, 1001, 1002))
    none = toxicity.fit_toxicity(docs, labels.where("false"))
    assert toxicity.score_toxicity(docs, none).where("score <> 0").count() == 0
    assert toxicity.score_toxicity(no_docs, model).count() == 0


def test_chain_marginals_match_enumeration():
    import itertools

    rng = np.random.default_rng(2)
    e, move = rng.normal(size=7), rng.normal(size=3)
    first, size = np.array([0, 4]), np.array([4, 3])
    r, b = toxicity.chain_logits(e, first, size, move)
    for a, n in zip(first, size):
        weight, on = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            s = sum(e[a + i] for i in range(n) if y[i]) + sum({(0, 0): 0, (0, 1): move[0], (1, 0): move[1], (1, 1): move[2]}[p] for p in zip(y, y[1:]))
            weight += np.exp(s)
            on += np.exp(s) * np.array(y)
        assert np.allclose(1 / (1 + np.exp(-(r + b)[a : a + n])), on / weight)


def test_marginals_follow_whole_sentences():
    weights, bias, move = np.zeros(toxicity.DIM), -1.2345, np.array([-0.7, 0.3, 0.9])
    weights[toxicity.hashed(["w=bad"])] = 2.3456
    weights[toxicity.hashed(["w=fine"])] = -0.7891
    model = toxicity.ToxicModel(weights, bias, move)
    sentences = [["so", "bad", "fine."], ["bad!"], ["bad", "bad", "so", "fine"]]
    p, offsets = model.marginals([" ".join(sentences[0] + sentences[1]), "", " ".join(sentences[2])])
    assert offsets.tolist() == [0, 4, 4, 8]
    want = []
    for s in sentences:
        e = np.array([bias + sum(weights[f] for f in toxicity.hashed(toxicity.word_features(w))) for w in s])
        r, b = toxicity.chain_logits(e, np.array([0]), np.array([len(s)]), move)
        want.extend(1 / (1 + np.exp(-(r + b))))
    assert np.allclose(p, want, atol=2e-3)
