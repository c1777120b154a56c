"""Files read and written: records, questions, graphs and results."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quern.operators import hub, reports
from quern.sources import graphs, questions, records, results, tables

md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
RECORD = {"NO": "1", "Customer": "A", "Engineers": "B", "Service Start": "2024-01-01", "Service End": "2024-01-02", "Description": "d", "Action": "a"}


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n", encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("mode", records.MODES)
def test_records(spark, tmp_path, mode):
    path = lines(tmp_path / "r.jsonl", [RECORD, {**RECORD, "NO": "2", "Customer": "客戶"}])
    got = sorted(records.read_records(spark, path, mode).collect(), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in got] == ["1", "2"] and got[1]["metadata"]["Customer"] == "客戶"
    for word in ("客戶", "d", "a"):
        assert word in got[1]["text"]
    if mode == "key_value_text":
        assert got[0]["text"] == "NO: 1\nCustomer: A\nEngineers: B\nStart Time: 2024-01-01\nEnd Time: 2024-01-02\nDescription: d\nAction: a"


def test_missing_fields(spark, tmp_path):
    short = lines(tmp_path / "r.jsonl", [{"NO": "1"}])
    assert "- **Customer**: N/A\n" in records.read_records(spark, short, "markdown").first()["text"]
    with pytest.raises(Exception, match="without 'Customer'"):
        records.read_records(spark, short).collect()
    with pytest.raises(ValueError, match="unknown mode"):
        records.read_records(spark, short, "html")
    (tmp_path / "bad.jsonl").write_text("{broken\n")
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        records.read_records(spark, str(tmp_path / "bad.jsonl")).collect()


def test_contexts(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(["  one ", "two"]))
    got = records.read_contexts(spark, str(tmp_path / "c.json")).orderBy("pos").collect()
    assert [(r["doc_id"], r["text"]) for r in got] == [(md5("one"), "one"), (md5("two"), "two")]
    for bad in ('["a", " "]', '{"a": 1}'):
        (tmp_path / "b.json").write_text(bad)
        with pytest.raises(Exception, match="blank|list"):
            records.read_contexts(spark, str(tmp_path / "b.json")).collect()


def test_sessions(spark, tmp_path):
    patient = {"case_number": "7", "age": 60, "blood_type": "A", "blood_rh": "+", "hbv": 1, "nurse_record": [["2024-01-02 08:00", "fine"], ["2024-01-01 09:30", "cough"], ["2024-01-01 10:00", ""]], "order": [["2024-01-01", "drug", "5", ""]], "a+p": [["2024-01-03", "rest"]], "fiber_list": [["2024-01-02", ["clear", "red"]], []]}
    path = lines(tmp_path / "p.jsonl", [patient])
    got = {r["metadata"]["session_date"]: r for r in records.read_sessions(spark, path).collect()}
    assert sorted(got) == ["2024-01-01", "2024-01-02", "2024-01-03"]
    assert got["2024-01-01"]["doc_id"] == md5("72024-01-01") and "血型 A+" in got["2024-01-01"]["text"] and "1/0/0" in got["2024-01-01"]["text"]
    assert "[09:30] cough\n--- 醫囑 ---\ndrug 5\n--- 評估計畫 ---\n（無）" in got["2024-01-01"]["text"]
    assert "--- 過濾器狀態 ---\nclear, red\n" in got["2024-01-02"]["text"] and "--- 評估計畫 ---\nrest" in got["2024-01-03"]["text"]


def test_sessions_in_every_mode(spark, tmp_path):
    patient = {"case_number": "7", "age": 60, "blood_type": "A", "blood_rh": "+", "hbv": 1, "nurse_record": [["2024-01-01 09:30", "cough"]], "order": [["2024-01-01", "drug", "5"]], "fiber_list": [["2024-01-01", "clear"]]}
    path = lines(tmp_path / "p.jsonl", [patient])
    text = lambda mode: records.read_sessions(spark, path, mode).first()["text"]
    head, none = "患者病歷號 7（60 歲，血型 A+，HBV/HCV/HIV: 1/0/0）", "（無）"
    assert text("natural_text") == f"{head}\n透析日期：2024-01-01\n--- 護理紀錄 ---\n[09:30] cough\n--- 醫囑 ---\ndrug 5\n--- 評估計畫 ---\n{none}\n--- 過濾器狀態 ---\nclear\n"
    assert text("markdown") == (
        "# 透析紀錄（2024-01-01）\n\n## 患者資訊\n- 病歷號: 7\n- 年齡: 60 歲\n- 血型: A+\n- HBV: 1, HCV: 0, HIV: 0\n\n"
        f"## 護理紀錄\n[09:30] cough\n\n## 醫囑\ndrug 5\n\n## 評估計畫 (A+P)\n{none}\n\n## 過濾器狀態\nclear\n"
    )
    assert text("key_value_text") == f"病歷號: 7\n年齡: 60\n血型: A+\nHBV/HCV/HIV: 1/0/0\n透析日期: 2024-01-01\n護理紀錄:\n[09:30] cough\n醫囑:\ndrug 5\n評估計畫:\n{none}\n過濾器狀態:\nclear\n"
    assert text("unstructured_text") == (
        f"=== TARGET TEXT FOR EXTRACTION ===\n{head}\n透析日期：2024-01-01\n\n護理紀錄:\n[09:30] cough\n\n醫囑:\ndrug 5\n\n評估計畫:\n{none}\n\n過濾器狀態:\nclear\n=================================="
    )
    meta = records.read_sessions(spark, path).first()["metadata"]
    assert meta["source"] == "p.jsonl" and meta["data_type"] == "bio" and meta["hcv"] == "0"
    with pytest.raises(ValueError, match="unknown mode"):
        records.read_sessions(spark, path, "other")


def test_records_in_every_mode(spark):
    row = {"NO": "n1", "Customer": "c", "Engineers": "e", "Service Start": "s", "Service End": "t", "Description": "d", "Action": "a"}
    df = spark.createDataFrame([row])
    text = lambda mode: records.record_documents(df, mode).first()["text"]
    for mode in records.MODES:
        want = records.TEMPLATES[mode]
        for k, v in row.items():
            for place in (f"{{{k}}}", *(f"{{{k}|{d}}}" for d in ("N/A", "無描述", "無動作"))):
                want = want.replace(place, v)
        assert text(mode) == want and "{" not in want


def test_citation_files(spark, tmp_path):
    body = 'idx,query,generated_answer,retrieved_ids\n1,"a, ""b""","one\n### References\n- [1] x\n- [2] y","x,y"\n2,' + "q" * 300 + ",no list,\n3,,,z\n"
    (tmp_path / "a.csv").write_text("\ufeff" + body, encoding="utf-8")
    (tmp_path / "b.csv").write_text(body, encoding="utf-8")
    for name in ("a.csv", "b.csv"):
        rows = results.read_citations(spark, str(tmp_path / name)).orderBy("row_index").collect()
        assert [(r["file"], r["row_index"], r["idx"], r["query"], r["ids"]) for r in rows] == [(name, 1, "1", 'a, "b"', "x,y"), (name, 2, "2", "q" * 200, ""), (name, 3, "3", None, "z")]
        audit = reports.citation_audit(results.read_citations(spark, str(tmp_path / name)), "row_index", "answer", "ids").orderBy("row_index").collect()
        assert [(r["has_heading"], r["n_references"], r["sequential"], r["count_match"]) for r in audit] == [(True, 2, True, True), (False, 0, False, True), (False, 0, False, False)]
    both = results.read_citations(spark, str(tmp_path / "*.csv"), answer="none", most=2)
    assert sorted((r["file"], r["row_index"], r["answer"]) for r in both.collect()) == [(f, i, "") for f in ("a.csv", "b.csv") for i in (1, 2)]


def test_chunk_ids(spark, tmp_path):
    path = str(tmp_path / "map")
    save = lambda *rows: results.save_chunk_ids(spark.createDataFrame(rows, "chunk_id string, no string"), path)
    save(("c1", "n1"), ("c2", "n2"))
    save(("c2", "n3"), ("c3", "n1"))
    asked = spark.createDataFrame([("q", "c2", 1), ("q", "c3", 2), ("q", "c1", 3), ("q", "none", 4), ("r", "none", 1)], "qid string, chunk_id string, rank int")
    assert [tuple(r) for r in results.original_ids(spark, path, asked).orderBy("rank").collect()] == [("q", "n3", 1), ("q", "n1", 2)]


def test_processed_documents_come_back(spark, tmp_path):
    docs = spark.createDataFrame([("1", "ä text", {"k": "v"}), ("2", None, None)], "doc_id string, text string, metadata map<string,string>")
    records.write_documents(docs, str(tmp_path / "docs"))
    back = spark.read.schema("doc_id string, text string, metadata map<string,string>").json(str(tmp_path / "docs"))
    assert sorted(map(repr, back.collect())) == sorted(map(repr, docs.collect()))
    more = records.union_all([docs.select("doc_id", "text"), docs.select("doc_id", "metadata")])
    assert more.columns == ["doc_id", "text", "metadata"] and more.count() == 4


def test_questions(spark, tmp_path):
    (tmp_path / "q.csv").write_text('Q,GT,REF,Q_type\n"a, b?",yes,d1,Single Hop\n"two\nlines",no,,multi_hop\n', encoding="utf-8")
    got = questions.read(spark, "csr_csv", str(tmp_path / "q.csv")).collect()
    assert [(r["query"], r["ground_truth_doc_ids"], r["qa_scope"], r["source"]) for r in got] == [("a, b?", ["d1"], "local", "q.csv"), ("two\nlines", [], "global", "q.csv")]
    path = lines(tmp_path / "q.jsonl", [{"question": "x", "answer": "y", "source_doc_ids": ["1", "2"], "hop_level": "2-hop"}, {"question_type": "local"}])
    got = questions.read(spark, "csr_jsonl", path).collect()
    assert [(r["query"], r["ground_truth_answer"], r["ground_truth_doc_ids"], r["qa_scope"]) for r in got] == [("x", "y", ["1", "2"], "global"), ("", "", [], "local")]
    path = lines(tmp_path / "u.jsonl", [{"input": "i", "question": "q", "answers": [" a ", "", "b"], "context": " c "}, {"input": "", "question": "q", "answer": " one ", "source_doc_ids": ["z"]}, {"question": "n"}])
    got = questions.read(spark, "ultradomain_jsonl", path).collect()
    assert [(r["query"], r["ground_truth_answer"], r["ground_truth_doc_ids"]) for r in got] == [("i", "a\nb", [md5("c")]), ("q", "one", ["z"]), ("n", "", [])]
    with pytest.raises(ValueError, match="unknown question loader"):
        questions.read(spark, "xlsx", path)


def test_list_literals(spark, tmp_path):
    cells = ["['a', \" it's \", 'a']", '["j", "k"]', "plain text", "", "['it\\'s', 'x, y']", "[broken", "[]"]
    rows = "user_input,reference,reference_contexts\n" + "".join(f'q{i}, r ,"{c.replace(chr(34), chr(34) * 2)}"\n' for i, c in enumerate(cells))
    (tmp_path / "m.csv").write_text(rows, encoding="utf-8")
    got = {r["query"]: r["ground_truth_doc_ids"] for r in questions.read(spark, "ragas_metadata_csv", str(tmp_path / "m.csv")).collect()}
    want = [["a", "it's"], ["j", "k"], ["plain text"], [], ["it's", "x, y"], ["[broken"], []]
    assert got == {f"q{i}": [md5(t) for t in w] for i, w in enumerate(want)}


def test_graphml(spark, sf_dir, tmp_path):
    nodes = spark.createDataFrame([("a<&>", "T", 'say "x"'), ("b", "T", "B")], "id string, type string, name string")
    edges = spark.createDataFrame([("a<&>", "b", "knows", 2.5)], "src string, dst string, relation string, weight double")
    graphs.write_graphml(hub.Graph(nodes, edges), str(tmp_path / "g"))
    back = graphs.read_graphml(spark, str(tmp_path / "g"))
    assert sorted(map(tuple, back.nodes.select("id", "type", "name").collect())) == sorted(map(tuple, nodes.collect()))
    assert [tuple(r) for r in back.edges.select("src", "dst", "relation", "weight").collect()] == [("a<&>", "b", "knows", 2.5)]
    big = hub.trade_graph(spark, sf_dir)
    graphs.write_graphml(big, str(tmp_path / "big"))
    again = graphs.read_graphml(spark, str(tmp_path / "big"))
    cols = ("src", "dst", "relation", "weight")
    assert again.edges.select(*cols).exceptAll(big.edges.select(*cols)).isEmpty() and big.edges.select(*cols).exceptAll(again.edges.select(*cols)).isEmpty()
    assert again.nodes.count() == big.nodes.count()
    assert graphs.graph_files(spark, str(tmp_path / "big")).agg(F.sum("nodes"), F.sum("edges")).first() == (big.nodes.count(), big.edges.count())
    foreign = '<graphml><key id="d0" for="node" attr.name="entity_type"/><key id="d1" for="edge" attr.name="weight"/><graph><node id="x"><data key="d0">P</data></node><node id="y"/><edge source="x" target="y"><data key="d1">3</data></edge></graph></graphml>'
    (tmp_path / "f.graphml").write_text(foreign)
    g = graphs.read_graphml(spark, str(tmp_path / "f.graphml"))
    assert sorted(tuple(r) for r in g.nodes.select("id", "type", "name").collect()) == [("x", "P", "x"), ("y", "Entity", "y")]
    assert tuple(g.edges.select(*cols).first()) == ("x", "y", "RELATED_TO", 3.0)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        graphs.read_graphml(spark, str(tmp_path / "none")).nodes.collect()


def test_graph_json(spark, sf_dir, tmp_path):
    g = hub.trade_graph(spark, sf_dir)
    graphs.write_json(g, str(tmp_path / "j"))
    back = graphs.read_json(spark, str(tmp_path / "j"))
    assert back.nodes.exceptAll(g.nodes).isEmpty() and back.edges.count() == g.edges.count()


def test_results(spark, tmp_path):
    rows = spark.createDataFrame([(1, "q", "SINGLE-HOP", 0.5, ["a"], 10), (2, "r", "MULTI-HOP", 1.0, [], 20)], "idx int, query string, Q_type string, hit double, chunks array<string>, total_tokens int")
    results.write_results(rows, str(tmp_path), "m1")
    results.write_results(rows.withColumn("total_tokens", F.col("total_tokens") * 2), str(tmp_path), "m2")
    back = results.read_results(spark, str(tmp_path))
    means = {r["row"]: (r["hit"], r["total_tokens"]) for r in back.where("method = 'm1' and row is not null").collect()}
    assert means == {"平均": (0.75, 15.0), "平均_SINGLE-HOP": (0.5, 10.0), "平均_MULTI-HOP": (1.0, 20.0)}
    table = results.comparison(back.where("idx is not null"), "method", "total_tokens", "m1").collect()
    assert sorted((r["method"], r["n"], r["mean_tokens"], r["utilisation"], r["place"]) for r in table) == [("m1", 2, 15.0, 100.0, 2), ("m2", 2, 30.0, 200.0, 1)]
    results.append_summary(spark.createDataFrame([("total", 1.0)], "scope string, hit double"), str(tmp_path / "s"), {"run": "1"})
    results.append_summary(spark.createDataFrame([("total", 2.0)], "scope string, mrr double"), str(tmp_path / "s"), {"run": "2"})
    assert sorted((r["run"], r["hit"], r["mrr"]) for r in results.read_summary(spark, str(tmp_path / "s")).collect()) == [("1", 1.0, None), ("2", None, 2.0)]


def test_metadata(spark, tmp_path):
    docs = records.read_records(spark, lines(tmp_path / "r.jsonl", [RECORD]))
    assert [(r["doc_id"], r["entity"]) for r in records.metadata_entities(docs).collect()] == [("1", "A"), ("1", "B")]
    assert sorted(map(tuple, records.metadata_triples(docs).collect())) == [("B", "HANDLED", "Record_1"), ("Record_1", "BELONGS_TO", "A")]


def test_catalogue():
    c = tables.DatasetCatalogue({"loader": "csr_csv", "mode": "a"}, {"x": {"mode": "b"}})
    assert c.resolve("x") == {"loader": "csr_csv", "mode": "b"}
    with pytest.raises(KeyError):
        c.resolve("y")
    assert tables.artifact_name("csr", "khop", "hybrid", 5, "t", True) == "csr_khop_hybrid_k5_t_fast_test"


def test_graphml_takes_little_room(spark, tmp_path):
    """Markup is compressed: a graph's files take a fifth of their text at most."""
    edges = spark.range(5000).selectExpr("concat('O:', id) src", "concat('P:', id % 97) dst", "'contains' relation", "1.0D weight")
    nodes = spark.createDataFrame([("a", "t", "a")], "id string, type string, name string")
    graphs.write_graphml(hub.Graph(nodes, edges), str(tmp_path / "g"))
    text = spark.read.text(str(tmp_path / "g")).selectExpr("sum(length(value) + 1) n").first()["n"]
    assert 0 < sum(p.stat().st_size for p in (tmp_path / "g").glob("part-*")) * 5 < text
    assert graphs.read_graphml(spark, str(tmp_path / "g")).edges.count() == 5000
