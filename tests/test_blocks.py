"""Searches in blocks, merges and cut-offs where ids repeat, places are large or values missing."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from quern.functions.vectors import similar_pairs, top_by_cosine
from quern.operators import merge as U
from quern.operators import retrieve as R


@pytest.mark.parametrize("size", [(1024, 4096), (3, 7)])
def test_top_by_cosine_of_all_pairs(spark, size):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(60)] + [(60, [0.0] * 4)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {(r["query"], r["rank"]): (r["item"], r["score"]) for r in top_by_cosine(df, df, 5, "id", "id", "v", size).collect()}
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, v in rows}
    assert len(got) == 61 * 5
    for i, a in unit.items():
        best = sorted((-round(float(a @ b), 9), j) for j, b in unit.items())[:5]
        for k, (score, j) in enumerate(best, 1):
            assert got[i, k][0] == j and got[i, k][1] == pytest.approx(-score, abs=1e-8)


def test_more_queries_than_a_driver_takes(spark):
    """100,001 queries, which once was an error."""
    many = spark.range(100_001).selectExpr("id", "array(cast(id % 7 + 1 as double), 1.0D) v")
    items = spark.range(3).selectExpr("id", "array(cast(id * 3 as double), 1.0D) v")
    found = top_by_cosine(many, items, 1, "id", "id", "v")
    assert found.count() == 100_001 and found.where("query = 6 and item = 2").count() == 1
    assert top_by_cosine(many.limit(0), items, 1, "id", "id", "v").count() == top_by_cosine(items, many.limit(0), 1, "id", "id", "v").count() == 0


def test_best_types(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [-1.0, 0.0])], "id long, v array<double>")
    t = spark.createDataFrame([("x", [2.0, 0.0]), ("w", [1.0, 0.0]), ("y", [0.3, 0.9])], "type string, v array<double>")
    got = {r["id"]: r["type"] for r in U.best_types(e, t).collect()}
    assert got == {1: "w", 2: "y"}


MENTION = "id string, name string, type string, properties map<string,string>, aliases array<string>, confidence double, source string, pos long"


def test_graphs_in_order_whatever_their_places(spark):
    edge = "src string, relation string, dst string, confidence double, pos long"
    first = spark.createDataFrame([("a", "r", "b", 0.5, (1 << 41) + 5), ("c", "r", "d", 0.1, 1)], edge)
    second = spark.createDataFrame([("a", "r", "b", 0.5, 3), ("c", "r", "d", 0.9, 1 << 50)], edge)
    one = spark.createDataFrame([("n", "first", "t", {"k": "1"}, ["x"], 0.5, "s", 1 << 45)], MENTION)
    two = spark.createDataFrame([("n", "second", "t", {"k": "2"}, ["y"], 0.5, "s", 0)], MENTION)
    nodes, edges = U.merge_graphs([one, two], [first, second])
    assert {(r["src"], r["graph"], r["pos"]) for r in edges.collect()} == {("a", 0, (1 << 41) + 5), ("c", 0, 1)}
    assert {r["src"]: r["confidence"] for r in edges.collect()} == {"a": 0.5, "c": 0.9}
    n = nodes.first()
    assert n["name"] == "first" and n["properties"] == {"k": "2"} and n["aliases"] == ["x", "y"] and n["graph"] == 0


def test_missing_maps_and_lists_take_nothing_away(spark):
    rows = [
        ("e", "A", "t", {"k": "1", "l": "2"}, ["x"], 0.9, "s", 1), ("e", "B", "t", None, None, 0.5, "u", 2), ("e", "C", "t", {"k": None}, [], 0.5, None, 3),
        ("none", "N", "t", None, None, None, None, 4), (None, "no id", "t", {"z": "1"}, ["q"], 0.1, "s", 5),
    ]
    got = {r["id"]: r for r in U.merge_entities(spark.createDataFrame(rows, MENTION)).collect()}
    assert got["e"]["properties"] == {"k": None, "l": "2"} and got["e"]["aliases"] == ["x"] and got["e"]["name"] == "A" and got["e"]["source"] == "s+u" and got["e"]["merged"] == 3
    assert got["none"]["properties"] == {} and got["none"]["aliases"] == [] and got[None]["properties"] == {"z": "1"}


def by_hand(rows, most, tail):
    """Rows of each group in order of id (equal ids: in whatever order of equal sizes) while their tokens fit."""
    out, running = Counter(), Counter()
    for g, i, t in sorted(rows, key=lambda r: (r[0], r[1])):
        n = len(re.findall(r"[A-Za-z0-9_]+", t))
        left = most - running[g]
        if running[g] + n <= most:
            out[g, i, t, n] += 1
        elif left > tail:
            out[g, i, t, left] += 1
        running[g] += n
    return out


def test_cut_offs_with_repeated_ids(spark):
    rows = [("g", 1, "a b c"), ("g", 1, "a b c"), ("g", 1, "d e f"), ("g", 2, "x " * 90), ("g", 3, "late"), ("h", 1, "one two"), ("h", 1, "one two"), ("h", 1, "one two")]
    df = spark.createDataFrame(rows, "g string, i long, t string")
    got = Counter((r["g"], r["i"], r["t"], r["kept_tokens"]) for r in R.within_tokens(df, "g", "i", "t", 80).collect())
    assert got == by_hand(rows, 80, 50)
    first = Counter((r["g"], r["i"], r["t"]) for r in R.within_tokens_keep_first(df, "g", "i", "t", 5).collect())
    assert first["h", 1, "one two"] == 2 and sum(n for k, n in first.items() if k[0] == "g") == 1
    assert R.within_tokens(df, "g", "i", "t", 0).count() == len(rows)


@pytest.mark.parametrize("seed", range(3))
def test_short_and_long_items_in_texts(spark, seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choices("ab c", k=n))
    items = [(i, text(rng.choice([0, 1, 2, 3, 5, 9, 14]))) for i in range(60)] + [(60, "é"), (61, "  "), (62, None)]
    docs = [(i, text(rng.choice([0, 1, 5, 40, 90]))) for i in range(60)] + [(60, "aé b"), (61, None)]
    got = {tuple(r) for r in R.containing_pairs(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = {(i, d) for i, s in items for d, t in docs if s and t and s in t}
    assert got == want and {tuple(r) for r in R.containing_pairs(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"), shorter=True).collect()} == want


def test_bytes_decide_what_travels(spark):
    df = spark.createDataFrame([("x" * 1000, 1, ["a" * 500])] * 3, "t string, n long, l array<string>")
    assert 4500 < R.bytes_of(df) < 5500 and R.bytes_of(df.limit(0)) == 0
    assert R.carried(df, 100) is df and R.carried(df, 10_000) is not df


def test_bm25_the_same_by_lookup_and_by_join(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "")], "id long, text string"))
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").selectExpr("item_id qid", "text")
    rows = lambda within: {(r["qid"], r["id"]): round(r["score"], 9) for r in R.bm25(docs, asked, within=within).collect()}
    found = rows(R.WITHIN)
    assert found and found == rows(0)


def test_similar_pairs_travel_in_few_blocks(spark):
    """3,000 vectors meet in one block; strips of its products give the pairs that all products give. Single precision is as good as double."""
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(3000, 4)).astype("float32")
    unit = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1, keepdims=True)
    want = {(i, j) for i, j in np.argwhere(unit @ unit.T >= 0.999).tolist() if i < j}
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id long, v array<float>")
    for one, size in ((df, {}), (df, {"size": 700, "strip": 100}), (df.selectExpr("id", "cast(v as array<double>) v"), {"strip": 999})):
        got = [(r["a"], r["b"]) for r in similar_pairs(one, "id", "v", 0.999, **size).collect()]
        assert set(got) == want and len(got) == len(want) > 50
    assert blocks_of(similar_pairs(df, "id", "v", 0.999)) == 1


def blocks_of(df) -> int:
    """How many blocks a plan deals its rows to: what its sequence of partners ends with, and one."""
    return int(re.search(r"sequence\(block#?\d*L?, (\d+)", df._jdf.queryExecution().toString()).group(1)) + 1


def test_pairs_go_to_the_texts(spark, tmp_path):
    """Texts that are verified are not shuffled: the few pairs are carried to them."""
    docs = spark.createDataFrame([(k, f"a b c d{k} e f g") for k in range(40)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    items = spark.createDataFrame([(1, "b c d7 e f"), (2, "d9"), (3, "nowhere at all in it")], "item_id long, text string")
    found = R.containing_pairs(items, docs)
    assert {tuple(r) for r in found.collect()} == {(1, 7), (2, 9)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
