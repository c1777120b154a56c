"""BM25 in blocks gives what BM25 term by term gives."""

import pytest

from quern.operators import lexical, retrieve


def rows(df):
    return sorted((r["qid"], r["rank"], r["id"], round(r["score"], 8)) for r in df.collect())


@pytest.mark.parametrize("small", [False, True])
def test_as_term_by_term(spark, sf_dir, small, monkeypatch):
    if small:  # many blocks and many slices
        for name, value in (("QUERIES", 3), ("TEXTS", 7), ("PRODUCTS", 50)):
            monkeypatch.setattr(lexical, name, value)
    corpus = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id as id", "substring(text, 1, 400) as text").limit(60)
    queries = corpus.where("id % 4 = 0").withColumnRenamed("id", "qid")
    assert rows(lexical.bm25_top(corpus, queries, 5)) == rows(retrieve.top(retrieve.bm25(corpus, queries), 5))


def test_awkward_texts(spark):
    corpus = spark.createDataFrame([("a", "x y x"), ("b", "x y x"), ("c", None), ("d", ""), ("e", "x " * 5000), ("f", "z"), (None, "x")], "id string, text string")
    queries = spark.createDataFrame([(1, "x q"), (2, ""), (3, None), (4, "nowhere"), (5, "z Z z y")], "qid long, text string")
    known = corpus.where("id is not null")
    got = rows(lexical.bm25_top(corpus, queries, 2))
    assert got == rows(retrieve.top(retrieve.bm25(known, queries), 2))
    assert {q for q, *_ in got} == {1, 5} and [i for q, _, i, _ in got if q == 1][0] in ("a", "e")
    assert rows(lexical.bm25_top(corpus.limit(0), queries, 2)) == rows(lexical.bm25_top(corpus, queries.limit(0), 2)) == []


def test_slices_add_up(monkeypatch):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(1)
    asked = pd.DataFrame({"qid": range(9), "h": [np.unique(rng.integers(0, 30, 12)) for _ in range(9)]})
    asked["idf"] = [h / 10 + 0.5 for h in asked["h"]]
    texts = pd.DataFrame({"id": range(40), "h": [rng.integers(0, 40, rng.integers(0, 60)) for _ in range(40)]})
    mean = sum(map(len, texts["h"])) / 40
    whole = lexical._best(asked, texts, 6, 1.5, 0.75, mean)
    for products in (1, 13, 200):
        monkeypatch.setattr(lexical, "PRODUCTS", products)
        pd.testing.assert_frame_equal(lexical._best(asked, texts, 6, 1.5, 0.75, mean), whole, rtol=1e-12)
    for q, part in whole.groupby("qid"):
        idf = dict(zip(asked["h"][q], asked["idf"][q]))
        score = [sum(idf[w] * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * max(len(h), 1) / mean)) for w, n in zip(*np.unique(h, return_counts=True)) if w in idf) for h in texts["h"]]
        assert list(part["id"]) == [i for i in sorted(range(40), key=lambda i: (-round(score[i], 9), i)) if score[i] > 0][:6]


def test_texts_travel_once(spark, monkeypatch):
    """A thousand queries are one block, so that texts are not copied for each few hundred; slices of the scores change nothing."""
    corpus = spark.range(1000).selectExpr("id", "concat('w', id % 7, ' w', id % 11, ' w', id % 7, ' x', id % 40) text")
    queries = corpus.withColumnRenamed("id", "qid")
    dealt, made = lexical._dealt, []
    monkeypatch.setattr(lexical, "_dealt", lambda *a: made.append(dealt(*a)) or made[-1])
    whole = rows(lexical.bm25_top(corpus, queries, 3))
    assert made[0][1] == 1 and len(whole) == 3000
    monkeypatch.setattr(lexical, "CELLS", 9000)
    assert rows(lexical.bm25_top(corpus, queries, 3)) == whole == rows(retrieve.top(retrieve.bm25(corpus, queries), 3))


def test_counted_in_slices_of_asked_words(monkeypatch):
    """A batch is counted some words at a time, and only what is asked goes on; lengths stay those of whole texts."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(lexical, "SLICE", 10)
    texts = [[1, 2, 1], [], [5] * 25, [2, 9], [7]]
    batch = pa.RecordBatch.from_arrays([pa.array(list("abcde")), pa.array(texts, pa.list_(pa.int64()))], names=["id", "h"])
    parts = list(lexical._counted(iter([batch, batch.slice(0, 0)]), np.array([1, 2, 5])))
    assert len(parts) > 1
    got = {r["id"]: (r["n"], dict(zip(r["h"], r["tf"]))) for part in parts for r in part.to_pylist()}
    assert got == {"a": (3, {1: 2, 2: 1}), "b": (0, {}), "c": (25, {5: 25}), "d": (2, {2: 1}), "e": (1, {})}
    assert sum(part.num_rows for part in lexical._counted(iter([batch]), np.zeros(0, np.int64))) == 5


def test_bm25_query_goes_in_blocks(spark, sf_dir, monkeypatch):
    """The benchmark's BM25 shuffles counted texts and no row for each text and term."""
    from quern.plans import retrieval

    monkeypatch.setattr(retrieval.R, "bm25", None)
    assert retrieval.bm25_topk(spark, sf_dir).count() > 0


def test_texts_stay_where_they_lie(spark, monkeypatch):
    """However many blocks of queries there are, no text is dealt to them."""
    corpus = spark.range(200).selectExpr("id", "concat('w', id % 7, ' w', id % 11, ' x', id % 40) text")
    queries = corpus.where("id % 10 = 0").withColumnRenamed("id", "qid")
    monkeypatch.setattr(lexical, "QUERIES", 5)
    top, plans = lexical.top, []
    monkeypatch.setattr(lexical, "top", lambda scores, k: plans.append(scores._jdf.queryExecution().executedPlan().toString()) or top(scores, k))
    assert rows(lexical.bm25_top(corpus, queries, 3)) == rows(retrieve.top(retrieve.bm25(corpus, queries), 3))
    assert len(plans) == 4 and not any("Exchange" in p or "CoGroup" in p for p in plans)
