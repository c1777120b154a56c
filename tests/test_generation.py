"""ROUGE-Lsum, METEOR and the segmenter against all alignments and all splits."""

import math
import random
import re
from collections import Counter
from itertools import combinations, permutations

import pytest
from pyspark.sql import functions as F

from quern.functions import alignment as A
from quern.functions import metrics as M
from quern.operators import segment as G
from quern.plans import catalogue, reports


def table(x, y):
    t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            t[i + 1][j + 1] = t[i][j] + 1 if a == b else max(t[i][j + 1], t[i + 1][j])
    return t


def places_by_table(x, y):
    """The same subsequence by the whole table: give up the last word of x unless that shortens it, else y's, else take both."""
    t, i, j, out = table(x, y), len(x), len(y), set()
    while i and j:
        if t[i][j] == t[i - 1][j]:
            i -= 1
        elif t[i][j] == t[i][j - 1]:
            j -= 1
        else:
            out.add(i - 1)
            i, j = i - 1, j - 1
    return out


@pytest.mark.parametrize("seed", range(40))
def test_common_places(seed):
    rng = random.Random(seed)
    x, y = (rng.choices("abcd", k=rng.randint(0, 12)) for _ in range(2))
    got = A.common_places(x, y)
    assert got == places_by_table(x, y) and len(got) == table(x, y)[-1][-1]
    rest = iter(y)
    assert all(x[i] in rest for i in sorted(got))  # a subsequence of y


def lsum(answer, truth):
    have, need, hits = Counter(sum(answer, [])), Counter(sum(truth, [])), 0
    for s in truth:
        for i in sorted(set().union(*(places_by_table(s, a) for a in answer)) if answer else []):
            if have[s[i]] > 0 and need[s[i]] > 0:
                have[s[i]] -= 1
                need[s[i]] -= 1
                hits += 1
    n, m = sum(map(len, answer)), sum(map(len, truth))
    p, r = hits / n if n else 0, hits / m if m else 0
    return 2 * p * r / (p + r) if p + r else 0.0


def test_rouge_lsum_of_all_pairs(spark, sf_dir):
    split = lambda t: [re.findall(r"[a-z0-9_]+", s.lower()) for s in re.split(r"[.!?\n]+", t or "")]
    got = {r["key"]: r["rouge_lsum"] for r in catalogue.queries()["rouge_lsum"](spark, sf_dir).collect()}
    pairs = reports._pairs(spark, sf_dir).collect()
    assert len(got) == len(pairs) > 0
    for r in pairs:
        assert got[r["key"]] == pytest.approx(lsum(split(r["answer"]), split(r["truth"])), abs=1e-6)


def test_rouge_lsum_by_hand(spark):
    """The textbook case: w1..w5 against w1 w2 w6 w7 w8 and w1 w3 w8 w9 w5 has the union w1 w2 w3 w5."""
    s = lambda t: t.split()
    rows = [([s("1 2 6 7 8"), s("1 3 8 9 5")], [s("1 2 3 4 5")]), ([], [s("a")]), (None, None), ([[]], [[]]), ([s("a b"), None], [s("a b"), s("a b")])]
    df = spark.createDataFrame(rows, "a array<array<string>>, t array<array<string>>")
    p, r = 4 / 10, 4 / 5
    assert [x[0] for x in df.select(A.rouge_lsum(F.col("a"), F.col("t"))).collect()] == pytest.approx([2 * p * r / (p + r), 0, 0, 0, 2 * 1 * 0.5 / 1.5])


def fewest_chunks(x, y):
    """Over all largest matchings."""
    need = Counter(x) & Counter(y)
    best = 0
    if total := need.total():
        best = total
        for own in combinations(range(len(x)), total):
            if Counter(x[i] for i in own) == need:
                for other in permutations(range(len(y)), total):
                    if all(x[i] == y[j] for i, j in zip(own, other)):
                        steps = list(zip(own, other))
                        best = min(best, 1 + sum(b != (a[0] + 1, a[1] + 1) for a, b in zip(steps, steps[1:])))
    return total, best


@pytest.mark.parametrize("seed", range(60))
def test_chunks_over_all_matchings(seed):
    rng = random.Random(seed)
    x, y = (rng.choices("abc", k=rng.randint(0, 6)) for _ in range(2))
    assert A.matches_and_chunks(x, y) == fewest_chunks(x, y)
    assert A.longest_first(x, y) >= fewest_chunks(x, y)[1]


def test_long_pairs_end(spark):
    rng = random.Random(1)
    x = rng.choices("abcd", k=300)
    y = x[150:] + x[:150]
    assert A.matches_and_chunks(x, y) == (300, 2)
    rng.shuffle(y)
    total, chunks = A.matches_and_chunks(x, y)
    assert total == 300 and chunks <= A.longest_first(x, y)
    words = [str(i) for i in range(3000)]
    assert A.matches_and_chunks(words, words) == (3000, 1)


def test_meteor(spark):
    rows = [("the cat sat on the mat".split(), "on the mat sat the cat".split()), ("a b".split(), "a b".split()), (["x"], ["y"]), ([], []), (None, ["a"]), ("a b c".split(), "a".split())]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<string>, t array<string>").select(A.meteor(F.col("a"), F.col("t"))).collect()]
    third = 1 / 3 / (0.9 / 3 + 0.1)
    assert got == pytest.approx([1 - 0.5 * (3 / 6) ** 3, 1 - 0.5 * (1 / 2) ** 3, 0, 0, 0, third * 0.5])


def test_meteor_of_all_pairs(spark, sf_dir):
    words = lambda t: re.findall(r"[a-z0-9_]+", (t or "").lower())
    got = {r["key"]: r["meteor"] for r in catalogue.queries()["meteor"](spark, sf_dir).collect()}
    pairs = reports._pairs(spark, sf_dir).collect()
    assert len(got) == len(pairs) > 0
    for r in pairs:
        a, t = words(r["answer"]), words(r["truth"])
        m, chunks = A.matches_and_chunks(a, t)
        assert m == (Counter(a) & Counter(t)).total() and (m > 0) == (chunks > 0)
        score = 0.0 if not m else (m / len(a)) * (m / len(t)) / (0.9 * m / len(a) + 0.1 * m / len(t)) * (1 - 0.5 * (chunks / m) ** 3)
        assert got[r["key"]] == pytest.approx(score, abs=1e-6)


def splits(text):
    if not text:
        yield []
    for k in range(1, len(text) + 1):
        for rest in splits(text[k:]):
            yield [text[:k], *rest]


@pytest.mark.parametrize("seed", range(30))
def test_segmentation_over_all_splits(seed):
    rng = random.Random(seed)
    counts = {"".join(rng.choices("天地人", k=rng.randint(1, 3))): rng.randint(1, 50) for _ in range(rng.randint(0, 9))}
    s, total = G.Segmenter(counts), max(1, sum(counts.values()))
    text = "".join(rng.choices("天地人水", k=9))
    cost = lambda ws: sum(-math.log(counts[w] / total) if w in counts else -math.log(0.5 / total) if len(w) == 1 else math.inf for w in ws)
    got = s.words(text)
    assert "".join(got) == text and cost(got) == pytest.approx(min(map(cost, splits(text))))


def corpus():
    """Sentences of known words in random order, without spaces."""
    rng = random.Random(3)
    words = ["我", "喜歡", "蘋果", "吃", "電腦", "很", "貴", "維修", "工程師", "客戶", "服務", "了"]
    return [(i, "".join(rng.choices(words, k=12)) + "。 ok") for i in range(400)] + [(400, None), (401, ""), (402, "no run")], words


def test_words_are_learnt(spark):
    rows, words = corpus()
    texts = spark.createDataFrame(rows, "id long, text string")
    learnt = {r["word"]: r["n"] for r in G.learn(texts.select("text")).collect()}
    assert {w for w in words if len(w) > 1} <= set(learnt)
    s = G.Segmenter(learnt)
    assert s.tokens("客戶喜歡電腦。Hello World") == ["客戶", "喜歡", "電腦", "。hello", "world"]
    found = {r["id"]: r["words"] for r in G.segmented(texts, G.learn(texts.select("text"))).collect()}
    assert found[400] == found[401] == [] and found[402] == ["no", "run"]
    n = right = 0
    for i, t in rows[:400]:
        n += len(found[i])
        right += sum(w in words for w in found[i])
    assert right / n > 0.8


def test_metrics_take_the_segmenter(spark):
    rows, _ = corpus()
    tokens = G.tokenizer(spark, G.learn(spark.createDataFrame(rows, "id long, text string").select("text")))
    pair = spark.createDataFrame([(1, "我喜歡吃蘋果", "我喜歡電腦 ok!"), (2, None, "")], "key long, answer string, truth string")
    words = pair.select("key", tokens(F.col("answer")).alias("a"), tokens(F.col("truth")).alias("t"))
    assert [r["a"] for r in words.orderBy("key").collect()] == [["我", "喜歡", "吃", "蘋果"], []]
    scores = {r["key"]: r["f1"] for r in M.multiset_scores(M.overlap_counts(words, "key", "a", "t"), "key").collect()}
    assert scores == pytest.approx({1: 2 * 2 / (4 + 4), 2: 1.0})
    assert words.select(M.rouge_l(F.col("a"), F.col("t"))).first()[0] == pytest.approx(0.5)
    assert words.select(A.meteor(F.col("a"), F.col("t"))).first()[0] > 0


def test_empty_corpus_and_large_dictionary(spark):
    none = spark.createDataFrame([], "text string")
    assert G.learn(none).count() == 0 and G.Segmenter({}).words("天地") == ["天", "地"]
    with pytest.raises(ValueError):
        G.segmenter(spark.createDataFrame([("a", 1), ("b", 1)], "word string, n long"), most=1)


def test_unspaced_words_against_all_splits(spark, sf_dir):
    """Every turn keeps its letters; words of few letters are the cheapest of all splits."""
    docs = " ".join(r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()).lower()
    counts = Counter(re.findall("[a-z]+", docs))
    s = G.Segmenter(dict(counts), "[a-z]+", r"[^\sa-z]+")
    texts = {(r["conv_id"], r["turn"]): (r["text"] or "").lower() for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()}
    own = {k: "".join(re.findall("[a-z]+", t)) for k, t in texts.items()}
    got = catalogue.queries()["unspaced_words"](spark, sf_dir).collect()
    assert len(got) == len(own)
    cost = lambda ws: sum(s.cost.get(w, s.unknown if len(w) == 1 else math.inf) for w in ws)
    for r in got:
        assert r["words"].replace(" ", "") == own[r["conv_id"], r["turn"]]
        head = own[r["conv_id"], r["turn"]][:11]
        assert cost(s.words(head)) == pytest.approx(min(map(cost, splits(head))))
        words = set(re.findall("[a-z]+", texts[r["conv_id"], r["turn"]]))
        assert r["found"] == pytest.approx(len(words & set(r["words"].split())) / max(1, len(words)), abs=1e-6)
    assert sum(r["found"] for r in got) > 0


def test_common_grams_row_by_row(spark):
    """Runs of up to four tokens are counted where the row lies, without a shuffle."""
    rows = spark.createDataFrame([(1, list("abcab"), list("abxab")), (2, [], ["a"]), (3, None, None), (4, list("aaaa"), list("aa"))], "k int, a array<string>, t array<string>")
    found = rows.select("k", M.common_grams("a", "t").alias("m"))
    assert {r["k"]: r["m"] for r in found.collect()} == {1: [4, 2, 0, 0], 2: [0] * 4, 3: [0] * 4, 4: [2, 1, 0, 0]}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
