"""The language model against sums over all segmentations, written out."""

import math
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import lm_score as L


def ways(word, lattice):
    """All segmentations of a word, as rows of the lattice's weights."""

    def rest(x):
        if not x:
            yield [len(lattice.weights) - 1]
        for j in range(1, len(x) + 1):
            if x[:j] in lattice.inner:
                rows = [lattice.inner[x[:j]]]
            elif j == 1:
                rows = [lattice.bytes_at + b for b in x[0].encode("utf-8", "surrogatepass")]
            else:
                continue
            for more in rest(x[j:]):
                yield rows + more

    for piece, row in lattice.first.items():
        if word.startswith(piece):
            for more in rest(word[len(piece) :]):
                yield [row, *more]


def test_all_segmentations():
    rows = np.random.default_rng(0).random((6 + 257, 2)) + 0.01
    lattice = L.Lattice({"a": 0, "ab": 1, "": 2}, {"b": 3, "c": 4, "bc": 5}, rows).normalised()
    words = ["abc", "a", "bcbcb", "ébc", "", "漢\ud800b"]
    times = np.array([[1, 0], [1, 1], [0, 1], [2, 1], [1, 1], [0, 3.0]])
    want, uses = np.zeros((len(words), 2)), np.zeros_like(rows)
    for i, w in enumerate(words):
        for k in (0, 1):
            found = [(math.exp(lattice.weights[way, k].sum()), way) for way in ways(w, lattice)]
            want[i, k] = math.log(sum(p for p, _ in found))
            for p, way in found:
                np.add.at(uses[:, k], way, times[i, k] * p / math.exp(want[i, k]))
    assert np.allclose(lattice.log_probabilities(words), want)
    assert np.allclose(lattice.expected(words, times), uses)


def test_probabilities_add_up():
    rows = np.random.default_rng(1).random((4 + 257, 1)) + 0.01
    rows[4 : 4 + 256] = 1e-12  # so that nearly all mass is on words of a and b
    rows[-1] = 3.0  # and on short ones
    lattice = L.Lattice({"": 0}, {"a": 1, "b": 2, "ab": 3}, rows).normalised()
    every, level = [""], [""]
    for _ in range(13):
        level = [w + c for w in level for c in "ab"]
        every += level
    total = np.exp(lattice.log_probabilities(every)).sum()
    assert 0.97 < total < 1.0 + 1e-9


def test_long_words_in_stretches():
    lattice = L.Lattice.of_vocabulary(2)
    n = 2 * L.STRETCH + 17
    inner = lattice.log_probabilities(["x" * n])
    assert np.isfinite(inner).all() and (inner < -1000).all()


def test_whole_scores(spark, sf_dir):
    docs = {r["doc_id"]: (r["text"], r["lang"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    frame = spark.createDataFrame([(i, t, k, zlib.crc32(str(i).encode()) % 10 != 0) for i, (t, k) in docs.items()], "doc_id long, text string, kind string, train boolean")
    model, table = L.fit(frame)
    got = {r["doc_id"]: r for r in L.op6_lm_scoring(spark, sf_dir).collect()}
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    kinds = [k for k, _ in sorted(Counter(k for i, (_, k) in docs.items() if zlib.crc32(str(i).encode()) % 10).items(), key=lambda x: (-x[1], x[0]))]
    counts, texts = [Counter() for _ in kinds], Counter()
    for i, (t, k) in docs.items():
        if zlib.crc32(str(i).encode()) % 10:
            counts[kinds.index(k)].update(words(t))
            texts[kinds.index(k)] += 1
    own, total = [sum(c.values()) for c in counts], sum(counts, Counter())
    ends, n = sum(texts.values()), sum(own)
    lone = [(w, k) for k, c in enumerate(counts) for w, x in c.items() if x == 1]
    shared = (sum(total[w] > 1 for w, _ in lone) + 0.1) / (len(lone) + 0.2)
    new = [min(1.0, max(1e-3, (sum(1 for _, j in lone if j == k) + 1) / (own[k] + 1))) for k in range(len(counts))]
    end = (ends + 0.1) / (n + ends + 0.2)
    lattice = model.lattice

    @lru_cache(None)
    def spelled(word, k):
        """The sum over segmentations by recursion from the word's end."""
        weights = np.exp(lattice.weights[:, k])

        @lru_cache(None)
        def rest(at):
            if at == len(word):
                return weights[-1]
            out = 0.0
            for j in range(at + 1, min(at + 40, len(word)) + 1):
                row = lattice.inner.get(word[at:j])
                if row is not None:
                    out += weights[row] * rest(j)
                elif j == at + 1:
                    out += np.prod(weights[[lattice.bytes_at + b for b in word[at].encode()]]) * rest(j)
            return out

        if len(word) > 300:  # deeper than the recursion here may go
            return math.exp(lattice.log_probabilities([word])[0, k])
        return sum(weights[lattice.first[word[:j]]] * rest(j) for j in range(len(word) + 1) if word[:j] in lattice.first)

    held = [i for i in docs if zlib.crc32(str(i).encode()) % 10 == 0]
    for i in held:
        by = []
        for k in range(len(counts)):
            s = math.log10((texts[k] + 1) / (ends + len(counts))) + math.log10(end)
            for w in words(docs[i][0]):
                p = (1 - new[k]) * counts[k][w] / max(1, own[k]) + new[k] * (shared * total[w] / n + (1 - shared) * spelled(w, k))
                s += math.log10(p * (1 - end))
            by.append(s)
        want = max(by) + math.log10(sum(10 ** (x - max(by)) for x in by))
        assert got[i]["score"] == pytest.approx(want, rel=1e-6)
    c = total + Counter({0: ends})
    for i, (t, _) in docs.items():
        w = [*words(t), 0]
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n + ends)
        assert got[i]["base_score"] == pytest.approx(sum(np.log10((c[x] + 0.1) / (n + ends + 0.1 * (len(c) + 1))) for x in w))
    assert table.count() == len(total | Counter(w for t, _ in docs.values() for w in words(t)))


def test_held_out_beats_base(spark):
    row = L.op6_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    print("held-out log10", row["s"], "base", row["b"])
    assert row["s"] > row["b"]


def test_frequent_words_are_bounded(spark):
    table = spark.createDataFrame([(b"w%d" % i, 1 + i % 50, -1.0, [-2.0]) for i in range(1000)], "word binary, c long, base double, scores array<double>")
    words, values = L.frequent_words(table, 100)
    assert 0 < len(words) <= 100 and values.shape == (len(words), 2)
    assert {1 + int(w[1:]) % 50 for w in words} == set(range(51 - len(words) // 20, 51))  # whole counts, from the top
    assert L.frequent_words(table, 5)[0] == []


def test_kinds_and_null_texts(spark):
    rows = [(1, "a b a", "x", True), (2, None, "x", True), (3, "", None, True), (4, "c", "y", False), (4, "c", "y", False), (None, "a", "z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string, train boolean")
    model, table = L.fit(docs)
    got = L.scores(docs, model, table).collect()
    assert model.train_tokens == 6 and model.ends == 3 and len(model.texts) == 2
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"]) for r in got) == [(0, 2, 2), (1, 4, 4), (2, 1, 1), (3, 1, 1), (4, 2, 1), (4, 2, 1)]
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
