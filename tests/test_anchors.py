"""Anchors, filters, chunk graphs, planned filters and merges one after the other, on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from quern.operators import anchors as A
from quern.operators import hub
from quern.operators import merge as U
from quern.operators import planner as L
from quern.operators import retrieve as R
from quern.operators.chunks import chunk_graph, vector_context
from quern.operators.hub import Graph


def graph_of(spark, edges):
    nodes = sorted({x for e in edges for x in (e[0], e[1])})
    return Graph(spark.createDataFrame([(n, "t", f"name {n}") for n in nodes], "id string, type string, name string"), spark.createDataFrame(edges, "src string, dst string, relation string, weight double"))


def test_anchors(spark):
    mentions = [("q", 2, "Ann "), ("q", 1, "BOB"), ("q", 3, "ann"), ("q", 4, " "), ("q", 5, None), ("q", 6, "nobody"), ("r", 1, "nobody")]
    names = [("n2", "ann"), ("n1", "Ann"), ("n3", "bob"), ("n3", "Robert"), ("n4", None), ("n5", " ")]
    docs = [("q", 1, "d9"), ("q", 2, "n3"), ("r", 1, "d1"), ("r", 2, None)]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    m, n = df(mentions, "qid string, pos int, entity string"), df(names, "id string, name string")
    got = A.anchors(m, n, df(docs, "qid string, pos int, id string")).orderBy("qid", "rank").collect()
    assert [tuple(r) for r in got] == [("q", "n3", 1), ("q", "n1", 2), ("q", "n2", 3), ("q", "d9", 4), ("r", "d1", 1)]
    assert [r["id"] for r in A.anchors(m, n).orderBy("rank").collect()] == ["n3", "n1", "n2"]


def test_contexts_around_anchors(spark):
    g = graph_of(spark, [("a", "b", "knows", 2.0), ("b", "c", "knows", 5.0), ("c", "d", "knows", 1.0)])
    lines, ids = A.answer_contexts(g, spark.createDataFrame([("q", "a"), ("none", "z")], "qid string, id string"), hops=2)
    assert [(r["id"], r["rank"]) for r in ids.orderBy("rank").collect()] == [("b", 1), ("c", 2), ("a", 3)]
    assert [r["context"] for r in lines.orderBy("section", "rank").collect()] == ["t name b", "t name c", "t name a", "b -[knows]-> c", "a -[knows]-> b"]


def test_filters(spark):
    rows = spark.createDataFrame([("1", "x", "a+b", 0.5), ("2", "x", "b", 0.9), ("3", "y", None, None), ("4", "x", "ab", 0.4)], "id string, type string, source string, confidence double")
    ids = lambda **how: [r["id"] for r in rows.where(A.holds(**how)).orderBy("id").collect()]
    assert ids(type="x") == ["1", "2", "4"] and ids(source="a") == ["1", "4"] and ids(least=0.5) == ["1", "2"] and ids(source="b", least=0.5, type="x") == ["1", "2"] and ids() == ["1", "2", "3", "4"]
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a"), ("c", "d"), ("d", "b")], "src string, dst string")
    touched = lambda side: sorted(map(tuple, A.touching(edges, spark.createDataFrame([("a",), ("a",)], "id string"), side).collect()))
    assert touched("both") == [("a", "a"), ("a", "b"), ("b", "a")] and touched("src") == [("a", "a"), ("a", "b")] and touched("dst") == [("a", "a"), ("b", "a")]


def test_schema_items(spark):
    given = ["Server", "  ", None, json.dumps({"name": " A ", "description": "x"}), json.dumps({"type": "B", "desc": "y"}), json.dumps({"label": "C"}), json.dumps({"name": ""}), "{broken"]
    got = [r["i"] and tuple(r["i"]) for r in spark.createDataFrame([(g,) for g in given], "g string").select(A.schema_item(F.col("g")).alias("i")).collect()]
    assert got == [("Server", ""), None, None, ("A", "x"), ("B", "y"), ("C", ""), None, ("{broken", "")]


def test_chunk_graph_and_context(spark):
    chunks = R.hierarchical_chunks(spark.createDataFrame([(1, "x" * 20), (2, "")], "doc_id long, text string"), (16, 8, 4))
    g = chunk_graph(chunks)
    edges = {tuple(r) for r in g.edges.select("src", "relation", "dst").collect()}
    assert {("1:2:3", "parent", "1:1:1"), ("1:1:2", "parent", "1:0:1"), ("1:2:1", "previous", "1:2:0"), ("1:2:0", "next", "1:2:1")} <= edges
    assert len(edges) == (3 + 5) + 2 * (1 + 2 + 4) + 2 and hub.dangling(g).count() == 0
    hits = spark.createDataFrame([("q", "1:2:4", 0.5), ("q", "1:2:4", 0.9), ("q", "1:2:2", 0.7), ("q", "none", 1.0)], "qid string, id string, score double")
    got = vector_context(g, hits, depth=1).orderBy("rank").collect()
    assert [r["score"] for r in got][:3] == [0.9] * 3 and all(r["hop"] == 1 for r in got)
    assert {(r["src"], r["relation"], r["dst"]) for r in got} == {e for e in edges if {"1:2:4", "1:2:2"} & {e[0], e[2]}}
    only = vector_context(g, hits, depth=2, relations=["parent"])
    assert {(r["src"], r["dst"], r["hop"]) for r in only.collect()} == {("1:2:4", "1:1:2", 1), ("1:2:2", "1:1:1", 1), ("1:1:2", "1:0:1", 2), ("1:2:3", "1:1:1", 2), ("1:1:1", "1:0:0", 2)}
    assert vector_context(g, hits, depth=2, most=2).count() == 2


def test_plans_become_filters_that_reach_the_scan(spark, tmp_path):
    rows = [("1", "en", "New York"), ("2", "fr", "York"), ("3", "en", "old town"), ("4", None, "York")]
    spark.createDataFrame(rows, "id string, lang string, city string").write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    index = L.value_index(docs, ["lang", "city"])
    asked = spark.createDataFrame([("a", "What is new in NEW York, en or fr?"), ("b", "old-town"), ("c", "nothing"), ("d", None), ("e", "york")], "qid string, text string")
    plan = L.plans(asked, index)
    assert {tuple(r) for r in plan.collect()} == {("a", "city", "New York"), ("a", "city", "York"), ("a", "lang", "en"), ("a", "lang", "fr"), ("b", "city", "old town"), ("e", "city", "York")}
    got = {r["qid"]: (r["filters"], r["n"]) for r in L.passing(plan, docs, ["lang", "city"]).collect()}
    assert got == {"a": ("city=New York;city=York;lang=en;lang=fr", 2), "b": ("city=old town", 1), "e": ("city=York", 2)}
    for qid, (_, n) in got.items():
        found = docs.where(L.predicate([(r["attribute"], r["value"]) for r in plan.where(F.col("qid") == qid).collect()]))
        assert found.count() == n
        scan = found._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [" in scan and ("In(city" in scan or "EqualTo(city" in scan)
    assert L.plans(asked, index.limit(0)).count() == 0


def test_merges_one_after_the_other(spark):
    g = graph_of(spark, [("a", "x", "r", 1.0), ("b", "x", "r", 2.0), ("b", "y", "r", 1.0), ("c", "x", "r", 4.0), ("c", "z", "r", 1.0), ("c", "y", "r", 1.0)])
    groups = lambda *rows: lambda _: spark.createDataFrame(rows, "node string, component string")
    merged, names = U.chained(g, [groups(("a", "1"), ("b", "1"), ("c", "2")), groups(("b", "1"), ("c", "1"), ("x", "2"), ("y", "2"))])
    assert {tuple(r) for r in names.collect()} == {("a", "c"), ("b", "c"), ("c", "c"), ("x", "x"), ("y", "x")}
    assert {(r["src"], r["dst"]): r["weight"] for r in merged.edges.collect()} == {("c", "x"): 9.0, ("c", "z"): 1.0}
    assert {r["id"] for r in merged.nodes.collect()} == {"c", "x", "z"}


def test_typed_merge_rewrites_the_graph(spark):
    g = graph_of(spark, [("a", "x", "r", 1.0), ("b", "x", "r", 2.0), ("b", "y", "r", 1.0)])
    pairs = spark.createDataFrame([("a", "b", 0.9), ("x", "y", 0.9), ("b", "x", 0.95)], "a string, b string, sim double")
    typed = spark.createDataFrame([("a", "P"), ("b", "P"), ("x", "Q"), ("y", "R")], "id string, type string")
    merged, names = U.merge_typed(g, pairs, typed)
    assert {tuple(r) for r in names.collect()} == {("a", "b"), ("b", "b")} and {(r["src"], r["dst"]): r["weight"] for r in merged.edges.collect()} == {("b", "x"): 3.0, ("b", "y"): 1.0}


@pytest.mark.parametrize("by_length, want", [(False, "aaaa"), (True, "bb")])
def test_canonical_by_length(spark, by_length, want):
    groups = spark.createDataFrame([("aaaa", "g"), ("bb", "g")], "node string, component string")
    assert {r["canonical"] for r in U.canonical(groups, spark.createDataFrame([("aaaa", 3), ("bb", 3)], "id string, degree int"), by_length).collect()} == {want}
