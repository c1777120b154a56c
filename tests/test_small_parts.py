"""Small operators and helpers by hand: patterns, schema checks, cut lists, formats, statistics."""

import pytest
from pyspark.sql import functions as F

from quern.functions import metrics as M
from quern.functions import text as T
from quern.operators import hub as H
from quern.operators import merge as U
from quern.operators import pattern as C
from quern.operators import retrieve as R
from quern.operators.hub import Graph


@pytest.fixture(scope="module")
def graph(spark):
    nodes = [("a", "Server", "web"), ("b", "Server", "db"), ("c", "Client", "acme"), ("d", "Client", "web"), ("e", None, "odd")]
    edges = [("a", "b", "calls", 1.0), ("c", "a", "uses", 0.5), ("d", "b", "uses", 1.0), ("b", "e", "calls", None), ("c", "d", "knows", 1.0), ("c", "d", "knows", 1.0)]
    return Graph(spark.createDataFrame(nodes, "id string, type string, name string"), spark.createDataFrame(edges, "src string, dst string, relation string, weight double"))


PATTERNS = [
    "MATCH (c:Client)-[r:USES]->(s:Server {name: 'web'}) RETURN c", "MATCH (n {name: 'web'}) RETURN n", "MATCH ()-[:calls|knows]->() RETURN 1", "MATCH (a:Server)-->(b:Server)", "MATCH (n) RETURN n",
    "MATCH (c:Client)-[:NOTHING]->(d:Client) RETURN c", "MATCH (x) WHERE x.name IN ['acme', \"db\"] RETURN x", "MATCH (x {name: 'nobody'}) RETURN x", "", None,
]


def test_each_pattern_as_if_alone(spark, graph):
    rows = [(f"q{i}", p) for i, p in enumerate(PATTERNS)]
    got = {}
    for r in C.select_each(graph, spark.createDataFrame(rows, "qid string, pattern string")).collect():
        got.setdefault(r["qid"], set()).add((r["src"], r["relation"], r["dst"]))
    for qid, p in rows:
        assert got.get(qid, set()) == {tuple(r) for r in C.select(graph, p or "").collect()}, p
    assert got["q0"] == {("c", "uses", "a"), ("d", "uses", "b")} and got["q5"] == {("c", "knows", "d")} and "q4" not in got and "q7" not in got


def test_statistics(graph):
    got = {r["relation"]: (r["n"], r["share"], r["mean"], r["place"]) for r in H.relation_statistics(graph.edges, "weight").collect()}
    assert got == {"calls": (2, 2 / 6, 1.0, 1), "knows": (2, 2 / 6, 1.0, 2), "uses": (2, 2 / 6, 0.75, 3)}


def test_unknown_types(spark, graph):
    known = lambda *names: {r["id"] for r in H.unknown_types(graph.nodes, spark.createDataFrame([(n,) for n in names], "type string")).collect()}
    assert known("server") == {"c", "d", "e"} and known("Server", " client ") == {"e"} and known() == set()


def test_type_names(spark):
    """The usual case: a repeated name, numbered ones, one too short, an address."""
    names = spark.createDataFrame([(n, i) for i, n in enumerate(["Server", "Customer", "Server", "Server_001", "A", "IP_10_0_0_1", " Issue ", None, "Thing"])], "name string, pos int")
    assert [tuple(r) for r in H.type_names(names, ("thing",)).orderBy("pos").collect()] == [("Server", 0), ("Customer", 1), ("Issue", 6)]
    assert [r["name"] for r in H.type_names(names, most=2).orderBy("pos").collect()] == ["Server", "Customer"]


def test_formats_may_be_added(spark, graph):
    H.register_format("pairs", lambda df: H.from_triplets(df.select(F.col("x").alias("subject"), F.lit("with").alias("relation"), F.col("y").alias("object"))))
    made = H.convert("pairs", spark.createDataFrame([("a", "b")], "x string, y string"))
    assert made.nodes.count() == 2 and made.edges.first()["relation"] == "with"
    with pytest.raises(ValueError, match="unknown graph format"):
        H.convert("other", graph.nodes)


def test_lists(spark):
    lists = [spark.createDataFrame([("q", i, k + 1) for k, i in enumerate(ids)], "qid string, id string, rank int") for ids in (["a", "b", "c"], ["b", "d"])]
    assert [r["id"] for r in R.single(lists, 2).orderBy("rank").collect()] == ["a", "b"]
    rows = spark.createDataFrame([("q", "x", 2, "late"), ("q", "x", 1, "early"), ("r", "x", 3, "other")], "g string, v string, o int, note string")
    assert {tuple(r) for r in R.first_seen(rows, "v", "o").select("v", "note").collect()} == {("x", "early")}
    assert {tuple(r) for r in R.first_seen(rows, "v", "o", "g").select("g", "note").collect()} == {("q", "early"), ("r", "other")}
    scores = spark.createDataFrame([("q", i, float(s)) for i, s in enumerate((1, 3, 2))], "qid string, id long, score double")
    items = spark.createDataFrame([(0, "en"), (1, "fr"), (2, "en")], "id long, lang string")
    assert [r["id"] for r in R.filtered(scores, items, [F.col("lang") == "en"], 5).orderBy("rank").collect()] == [2, 0]


def test_texts(spark):
    row = spark.createDataFrame([([" a ", "", "a", "b", None], ["x,y", None, "\n z "], "Ünï_1 code-x 漢")], "c array<string>, ids array<string>, t string")
    got = row.select(T.clean_contexts(F.filter("c", lambda x: x.isNotNull())), T.flat_doc_ids(F.col("ids")), T.unicode_tokens(F.col("t"))).first()
    assert got[0] == ["a", "b"] and got[1] == ["x", "y", "z"] and got[2] == ["ünï_1", "code", "x", "漢"]


def test_metrics_may_be_added():
    M.register("always", lambda got, truth: F.lit(1.0))
    assert M.metric("always") is not None
    with pytest.raises(TypeError):
        M.register("no function", 3)
    with pytest.raises(KeyError):
        M.metric("unknown")


@pytest.mark.parametrize("rows", [[], [("a", "a")], [("a", None), (None, "b")], [("b", "a"), ("c", "b"), ("e", "d"), ("d", "e")]])
def test_components_of_few_pairs(spark, rows):
    got = {r["node"]: r["component"] for r in U.components(spark.createDataFrame(rows, "a string, b string")).collect()}
    assert got == ({"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"} if len(rows) == 4 else {})


def test_components_of_long_chains_and_hubs(spark):
    chain = [(i * 7919 % 1009, (i + 1) * 7919 % 1009) for i in range(400)]  # in no order
    hub = [(5000, 5000 + i) for i in range(1, 300)] + [(6000, 5299)]
    pairs = chain + hub
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in U.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for p in pairs for x in p}


def test_representatives_are_the_nearest_to_their_centres(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=3) + 9 * (i % 4)]) for i in range(80)]
    got = U.representatives(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 4).collect()
    assert len(got) == 4
    for r in got:
        own = [(i, np.array(v)) for i, v in rows if i % 4 == r["id"] % 4]  # four clusters far apart
        centre = np.mean([v for _, v in own], axis=0)
        nearest = min(own, key=lambda x: np.linalg.norm(x[1] - centre))
        assert r["id"] == nearest[0] and r["distance"] == pytest.approx(np.linalg.norm(nearest[1] - centre), abs=1e-6)


def test_session_lines_of_one_number_stay_in_order(spark, tmp_path):
    """Lines of an order that share day and number come as their table has them, as in the query's SQL."""
    import duckdb

    from quern.plans import catalogue

    lines = [(1, 2, p, "2020-01-02", f) for p, f in ((9, "R"), (1, "A"), (5, "N"), (3, "A"))] + [(1, 1, 7, "2020-01-02", "R"), (2, 1, 8, "2020-01-03", "N")]
    rows = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, day string, l_returnflag string")
    rows.withColumn("l_shipdate", F.col("day").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {tuple(r) for r in catalogue.queries()["sessions_read_back"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    found = con.sql(catalogue.oracle_sql()["sessions_read_back"])
    assert found.columns == ["doc_id", "text_md5", "case_number", "day"] and got == set(found.fetchall()) and len(got) == 2
