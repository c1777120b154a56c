"""The quality classifier: vectors and pooling by loops, and what the filtering stage leaves."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import quality as Q

CLASSES = ((r"[A-ZÀ-ÖØ-Þ]+", "\x01"), (r"[^\W\d_\x01]+", "\x02"), (r"\d+", "\x03"), (r"(.)\1+", r"\1"))


def buckets(word):
    shape = word
    for p, c in CLASSES:
        shape = re.sub(p, c, shape)
    return zlib.crc32(word.lower().encode()) % Q.WORDS, Q.WORDS + zlib.crc32(shape[:16].encode()) % Q.SHAPES


def test_context_vectors_by_loops(spark):
    texts = ["The cat sat on the mat, 42 times!!", None, "", "a b a b", "one", "The THE the  \n x9y"]
    vectors, counts = Q.context_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    places = Q.index_vectors()
    want, n = np.zeros((Q.BUCKETS, Q.DIMS)), np.zeros(Q.BUCKETS)
    for t in texts:
        words = [buckets(w) for w in (t or "").split()]
        for i, own in enumerate(words):
            for kind in (0, 1):
                n[own[kind]] += 1
                for j in range(max(0, i - Q.WINDOW), min(len(words), i + Q.WINDOW + 1)):
                    if j != i:
                        at = places[words[j][kind]]
                        np.add.at(want[own[kind]], at[: Q.ONES // 2], 1)
                        np.add.at(want[own[kind]], at[Q.ONES // 2 :], -1)
    assert (counts == n).all() and (vectors == want).all()
    pooling = Q.Pooling.of(vectors, counts)
    features = pooling.features(texts)
    for t, x in zip(texts, features):
        words = [buckets(w) for w in (t or "").split()]
        for kind in (0, 1):
            own = [w[kind] for w in words]
            mean = pooling.vectors[own].sum(0) / max(pooling.weights[own].sum(), 1e-9) if own else np.zeros(Q.DIMS)
            assert np.allclose(x[kind * Q.DIMS : (kind + 1) * Q.DIMS], mean, atol=1e-4)
        assert x[-1] == pytest.approx(np.log1p(len(words)) / 10)


@pytest.fixture(scope="module")
def classifier(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return Q.fit_on_labels(spark, docs, sf_dir)


def test_reject_leaves_columns_alone(spark, sf_dir, classifier):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.select("*", F.lit(123.0).alias("score"), F.lit("own").alias("Predicted"), F.col("doc_id").alias("__quality"), F.array(F.lit(1)).alias("features"))
    extra = spark.createDataFrame([(None, None, "en", None, None, 1.0, "y", 5, [1]), (1, "", None, "s", 0, 2.0, "x", 6, [1]), (1, "", None, "s", 0, 2.0, "x", 6, [1])], odd.schema)
    table = odd.unionByName(extra)
    kept = Q.reject(table, classifier)
    assert kept.dtypes == table.dtypes
    scores = {(r["doc_id"], r["text"]): r["p"] for r in classifier.score(table.drop("Predicted"), "p").collect()}
    key = lambda r: repr(tuple(r))
    want = sorted(key(r) for r in table.collect() if scores[r["doc_id"], r["text"]] >= 0.7)
    assert sorted(map(key, kept.collect())) == want and 0 < len(want) < table.count()
    assert Q.reject(table.limit(0), classifier).collect() == []


def test_scores_by_hand(spark, sf_dir, classifier):
    got = Q.op1_quality_classifier(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    net = classifier.network
    for r in got:
        x = classifier.pooling.features([texts[r["doc_id"]]])[0].astype(float)
        logit = float(np.tanh(((x - net.mean) / net.scale) @ net.w1 + net.b1) @ net.w2 + net.b2)
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-logit / net.temperature)), abs=1e-5)
        assert r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_sample_is_bounded_and_ties_agree(spark):
    rows = [(i, f"good words here {i}" if i % 2 else f"!!! {i} $$$") for i in range(400)] + [(3, "other text of three")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(3, 0), (None, 1), (4, None)], "doc_id long, label int")
    a = Q.Classifier.fit(docs, labels, sample=100)
    b = Q.Classifier.fit(docs.repartition(7), labels.repartition(3), sample=100)
    assert np.allclose(a.network.w1, b.network.w1) and a.network.temperature == b.network.temperature
    none = Q.Classifier.fit(docs, labels.limit(0))
    assert {round(r["score"], 6) for r in none.score(docs).collect()} == {0.5}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = Q.op1_quality_classifier(spark, sf).where("held_out").join(labels, "doc_id").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == k] for k in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    print("held-out AUC", auc)
    assert auc > 0.9


def test_words_learnt_in_bulk_have_the_buckets_of_one_by_one(monkeypatch):
    rng = np.random.default_rng(4)
    signs = list("abAÀÞ×ß_19.,!-éΩΣσςİ漢ªⅣ²ʰ\x01\x02…")
    words = {"".join(rng.choice(signs, rng.integers(1, 7))) for _ in range(5000)} | {"a\ud800b"}
    held = Q._Buckets()
    held.learn(words)
    for w in words - {"a\ud800b"}:
        word, shape = buckets(w)
        assert held[w] == word | shape << 20
    monkeypatch.setattr(Q, "CACHED", held.size - 1)
    held.learn({"new"})
    assert set(held) == {"new"} and held.size < 1000  # too many: all was forgotten first


def test_a_task_forgets_its_words():
    import pyarrow as pa

    Q._buckets.clear()  # of what other tests left in this process
    task = Q._forgetting(lambda batches: (Q._codes(b.column(0).to_pylist()) for b in batches))
    for _ in task(iter([pa.RecordBatch.from_arrays([pa.array(["some words", None])], ["t"])])):
        assert set(Q._buckets) == {"some", "words"}
    assert not Q._buckets and Q._buckets.size == 0
