"""Question sets, results that are scored afterwards, cells and schema facts, computed a second time by hand."""

import json

import pytest

from quern.functions import text as T
from quern.operators import qa, scores
from quern.sources import results

FIELDS = "NO string, Customer string, Description string, Action string"


def records(spark, n=25):
    rows = [(f"n{i}", "big" if i % 5 else "small", f"d{i}", "a" * 150) for i in range(n)]
    return spark.createDataFrame([*rows, ("x1", "few", "d", "a"), ("x2", "few", "d", "a"), ("x3", None, "d", "a"), ("x4", "", "d", None)], FIELDS)


def test_local_contexts(spark):
    r = records(spark)
    got = qa.local_contexts(r, 7).collect()
    assert [x["place"] for x in got] == list(range(1, 8))
    assert sorted(map(str, got)) == sorted(map(str, qa.local_contexts(r.repartition(5), 7).collect()))  # reruns agree
    assert {x["ids"][0] for x in got} != {x["ids"][0] for x in qa.local_contexts(r, 7, seed=1).collect()}
    every = qa.local_contexts(r, 100).collect()
    assert len(every) == 29 and {x["ids"][0] for x in every} == {x["NO"] for x in r.collect()}
    assert next(x["context"] for x in every if x["ids"] == ["x3"]) == "單號: x3\n客戶: None\n描述: d\n處置: a"
    assert qa.local_contexts(r.limit(0), 5).collect() == []


def test_global_contexts(spark):
    r = records(spark)
    got = {x["subject"]: x for x in qa.global_contexts(r, 10).collect()}
    assert set(got) == {"big", "small"}  # few has two records, and two have no customer
    assert len(got["big"]["ids"]) == len(set(got["big"]["ids"])) == 20 and len(got["small"]["ids"]) == 5
    assert sorted(x["place"] for x in got.values()) == [1, 2]
    lines = got["small"]["context"].split("\n")[:-1]
    assert lines == [f"單號:{i} | 描述:d{i[1:]} | 處置摘要:{'a' * 100}" for i in got["small"]["ids"]]
    assert len(qa.global_contexts(r, 1).collect()) == 1
    assert len(qa.global_contexts(r, 10, most=4).where("subject = 'big'").first()["ids"]) == 4
    assert qa.global_contexts(r.where("Customer is null"), 3).collect() == []


def test_pairs(spark):
    contexts = spark.createDataFrame([(i, "c", ["a", "b"]) for i in range(1, 8)], "place int, subject string, ids array<string>")
    replies = [
        (1, json.dumps({"question": "q1", "answer": "a1", "source_ids": ["z"]})), (2, "{'question': 'q2', 'answer': 'a2'}"), (3, "no json"), (4, None),
        (5, "[1, 2]"), (6, json.dumps({"answer": "a6", "source_ids": []})), (9, "{}"),
    ]
    rows = spark.createDataFrame(replies, "place int, response string")
    got = {r["id"]: r for r in qa.pairs(contexts, rows, "global").collect()}
    assert list(got) == ["qa_global_00000001", "qa_global_00000002", "qa_global_00000003"]
    assert [(r["question"], r["answer"], r["source_doc_ids"], r["confidence"]) for r in got.values()] == [("q1", "a1", ["z"], 0.97), ("q2", "a2", ["a", "b"], 0.97), ("", "a6", ["a", "b"], 0.97)]
    local = {r["id"]: r for r in qa.pairs(contexts, rows, "local").collect()}
    assert sorted(local) == ["qa_local_00000001", "qa_local_00000002", "qa_local_00000006"]
    assert {tuple(r["source_doc_ids"]) for r in local.values()} == {("a", "b")}
    with pytest.raises(ValueError):
        qa.pairs(contexts, rows, "else")


def test_scores_by_hand(spark):
    rows = spark.createDataFrame([(1, "a b c d", "a b c d"), (2, "a b", "b a"), (3, "", "a"), (4, None, None), (5, "a b x", "a b y z")], "k int, x string, y string")
    got = {r["k"]: r for r in scores.generation_scores(rows, "k", "x", "y").collect()}
    assert [round(got[1][c], 6) for c in scores.COLUMNS[:5]] == [1.0] * 5
    assert (got[2]["rouge1_zh"], got[2]["rouge2_zh"], got[2]["rougeL_zh"]) == (1.0, 0.0, 0.5)
    assert all(got[k][c] == 0.0 for k in (3, 4) for c in scores.COLUMNS)
    assert round(got[5]["rouge1_zh"], 6) == round(4 / 7, 6) and round(got[5]["rouge2_zh"], 6) == 0.4
    assert sorted(got) == [1, 2, 3, 4, 5]


def test_backfill(spark):
    rows = spark.createDataFrame(
        [("1", "a b", "a b", "local", 1.0), ("1", "a b", "a b", "local", 1.0), ("2", "a", "x", "global", 2.0), ("3", None, "x", None, 3.0), ("平均", None, None, None, 2.0)],
        "idx string, generated_answer string, ground_truth_answer string, Q_type string, kept double",
    )
    got = scores.backfilled(rows)
    assert [c for c in got.columns if c not in rows.columns] == list(scores.COLUMNS)
    of = sorted((r["idx"], r["rouge1_zh"], r["kept"]) for r in got.collect())
    assert of == [("1", 1.0, 1.0), ("1", 1.0, 1.0), ("2", 0.0, 2.0), ("3", 0.0, 3.0), ("平均", 0.5, 2.0)]
    assert scores.backfilled(got) is got  # nothing to do
    empty = got.select(*rows.columns, *[scores.F.lit(None).cast("double").alias(c) for c in scores.COLUMNS])
    assert sorted(r["rouge1_zh"] for r in scores.backfilled(empty).collect()) == [0.0, 0.0, 0.5, 1.0, 1.0]
    other = rows.drop("generated_answer")
    assert scores.backfilled(other) is other
    assert scores.backfilled(rows.limit(0)).collect() == []
    whole = scores.backfilled(results.detailed(rows.where("idx <> '平均'")), T.mixed_tokens).where("row is not null")
    assert {r["row"]: r["rouge1_zh"] for r in whole.collect()} == {"平均": 0.5, "平均_LOCAL": 1.0, "平均_GLOBAL": 0.0}


def test_refreshed(spark):
    zeros = ", ".join(f"{c} double" for c in scores.COLUMNS)
    rows = [("p", "1", "local", *[1.0] * 6), ("p", "2", "全域", *[3.0] * 6), ("p", "平均", "local", *[9.0] * 6), ("q", "1", "?", *[5.0] * 6)]
    details = spark.createDataFrame(rows, f"pipeline_name string, idx string, qa_scope string, {zeros}")
    known = {r["idx"]: r["s"] for r in details.select("idx", T.qa_scope(scores.F.col("qa_scope")).alias("s")).where("pipeline_name = 'p' and idx <> '平均'").collect()}
    summary = spark.createDataFrame([("p", "Total", 7.0), ("p", "local", 7.0), ("p", "global", 7.0), ("q", "total", 7.0), ("q", "local", 7.0), ("r", "total", 7.0)], "pipeline_name string, summary_scope string, avg_bleu_zh double")
    got = {(r["pipeline_name"], r["summary_scope"]): (r["avg_bleu_zh"], r["avg_meteor_zh"]) for r in scores.refreshed(summary, details).collect()}
    assert known["1"] == "local"
    rest = (3.0, 3.0) if known["2"] == "global" else (7.0, None)
    assert got == {("p", "Total"): (2.0, 2.0), ("p", "local"): (1.0, 1.0), ("p", "global"): rest, ("q", "total"): (5.0, 5.0), ("q", "local"): (7.0, None), ("r", "total"): (7.0, None)}
    old = {r["pipeline_name"]: r["avg_bleu_zh"] for r in scores.refreshed(summary.where("summary_scope = 'total'").drop("summary_scope"), details).collect()}
    assert old == {"q": 5.0, "r": 7.0}


def test_cells(spark):
    rows = spark.createDataFrame([(1, {"b": "x", "a": "é"}, [1, 2], (1, None)), (2, None, None, None), (3, {}, [], (None, "z"))], "idx int, m map<string,string>, l array<int>, s struct<p:int,q:string>")
    got = [tuple(r) for r in results.with_schema_info(results.cells(rows), {"n": 3}).orderBy("idx").collect()]
    assert got == [(1, '{"a":"é","b":"x"}', "[1,2]", '{"p":1}', 3), (2, None, None, None, None), (3, "{}", "[]", '{"q":"z"}', None)]


def test_scaled_keeps_rows(spark):
    from quern.operators import retrieve

    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", 2.0), (None, 4.0), (None, 8.0)], "g string, v double")
    got = sorted(((r["g"] or "", -1.0 if r["v"] is None else r["v"], r["scaled"]) for r in retrieve.scaled(rows, "g", "v").collect()), key=str)
    assert got == sorted([("a", 1.0, 0.0), ("a", 3.0, 1.0), ("a", -1.0, None), ("b", 2.0, 0.0), ("", 4.0, 0.0), ("", 8.0, 1.0)], key=str)
    assert retrieve.scaled(rows.limit(0), "g", "v").collect() == []


def test_evolved(spark):
    from quern.operators import reports

    anchors = spark.createDataFrame([("A",), ("B",), ("A",)], "name string")
    said = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (1, "B"), (3, "y"), (4, "z"), (5, "z"), (6, "z")], "batch int, name string")
    of = lambda **k: sorted((r["name"], r["is_anchor"], r["n"]) for r in reports.evolved(anchors, said, 7, **k).collect())
    assert of() == [("A", True, 0), ("B", True, 1), ("x", False, 2), ("z", False, 3)]  # at least 2 of 7
    assert of(most=1) == [("A", True, 0), ("B", True, 1), ("z", False, 3)]
    assert of(removed=spark.createDataFrame([("z",), ("A",)], "name string")) == [("B", True, 1), ("x", False, 2)]
    assert [n for n, _, _ in of(share=0.1)] == ["A", "B", "x", "y", "z"]
