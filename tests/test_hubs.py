"""Searches around hubs: what lies behind one is not spread out for each query, and the results are those of the whole search."""

import random

import pytest

from quern.operators import prizes, traverse
from quern.operators.hub import Graph

SPOKES = 400


@pytest.fixture(scope="module")
def town(spark):
    """A hub with 400 spokes, ten of which ask; each asker has three neighbours of its own, shared by some."""
    rng = random.Random(3)
    pairs = [(f"n{i:03}", "hub", 1.0) for i in range(SPOKES)] + [(f"n{i:03}", f"m{(3 * i + k) % 25:02}", rng.choice([0.5, 1.0, 4.0, 4.0 + 1e-12])) for i in range(10) for k in range(3)]
    pairs += [(f"m{i:02}", f"n{rng.randrange(20, SPOKES):03}", rng.choice([0.5, 1.0, 8.0])) for i in range(25)]
    nodes = sorted({n for p in pairs for n in p[:2]})
    return Graph(spark.createDataFrame([(n, "t", n) for n in nodes], "id string, type string, name string"), spark.createDataFrame([(a, b, "r", w) for a, b, w in pairs], "src string, dst string, relation string, weight double"))


def watched(monkeypatch, module):
    written, cut = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df: written.append(cut(df)) or written[-1])
    return lambda: max(df.count() for df in written if "qid" in df.columns)


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("top_k", [3, 30])
def test_beam(spark, town, monkeypatch, top_k):
    seeds = spark.createDataFrame([(f"q{i}", f"n{i:03}", 1) for i in range(10)] + [("h", "hub", 1)], "qid string, id string, rank int")
    most = watched(monkeypatch, traverse)
    got = rows(traverse.beam(town, seeds, width=4, top_k=top_k))
    few = most()
    monkeypatch.setattr(traverse, "_heaviest", lambda near, most: near)
    assert got == rows(traverse.beam(town, seeds, width=4, top_k=top_k))
    assert few < 11 * 4 * 40 < most()


def test_anchor_hybrid(spark, town, monkeypatch):
    seeds = spark.createDataFrame([(f"q{i}", f"n{i:03}") for i in range(10)], "qid string, id string")
    asked, texts = seeds.selectExpr("qid", "'m01 m07' AS text"), town.nodes.selectExpr("id", "name AS text")
    most = watched(monkeypatch, traverse)
    got = rows(traverse.anchor_hybrid(town, seeds, texts, asked, hops=2, top_k=6))
    few = most()
    monkeypatch.setattr(traverse, "best_neighbours", lambda near, deg, most: near)
    assert got == rows(traverse.anchor_hybrid(town, seeds, texts, asked, hops=2, top_k=6)) and len(got) == 60
    assert few < 10 * 25 < SPOKES < most()


def test_steiner(spark, town, monkeypatch):
    """Two terminals that share a cheap neighbour don't ask what lies behind the hub."""
    seeds = spark.createDataFrame([("x", "n001", 1), ("x", "n009", 2)], "qid string, id string, rank int")
    most = watched(monkeypatch, traverse)
    edges = spark.createDataFrame([("n001", "bridge", "r", 9.0), ("bridge", "n009", "r", 9.0)], "src string, dst string, relation string, weight double")
    graph = Graph(town.nodes.union(spark.createDataFrame([("bridge", "t", "b")])), town.edges.union(edges))
    got = {(r["qid"], r["id"]): r["role"] for r in traverse.steiner(graph, seeds, min_nodes=0).collect()}
    assert got == {("x", "n001"): "terminal", ("x", "n009"): "terminal", ("x", "bridge"): "steiner"}
    assert most() < SPOKES / 4


def test_balls_end_at_the_hub(spark, town, monkeypatch):
    """With prizes of 1.6 and edges of 1 the ball around a spoke holds the hub and nothing behind it, which is never looked at."""
    steps, ends = traverse.bounded(traverse.both_ways(town.edges).selectExpr("*", "1.0D AS cost"))
    reach = spark.createDataFrame([("q", "n300", 1.6), ("q", "n301", 1.6), ("q", "nowhere", 1.6)], "qid string, source string, radius double")
    rounds = []
    broadcast = traverse.F.broadcast
    monkeypatch.setattr(traverse.F, "broadcast", lambda df: rounds.append(df.count()) or broadcast(df))
    ball = traverse.balls(steps, ends, reach)
    assert rounds == [2] and {"hub", "n300", "n301", "nowhere"} <= {r["id"] for r in ball.collect()}
    up = prizes.upward(steps).selectExpr("lo", "hi", "1.0D AS cost")
    assert [(r["a"], r["b"], r["d"]) for r in prizes.meetings(ball, up).collect()] == [("n300", "n301", 2.0)]


def test_missing_ends_among_distinct_ones(spark, monkeypatch):
    """Nodes too many to be carried meet distinct ends; repeated edges and null ends stay."""
    from quern.operators import hub

    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    edges = spark.createDataFrame([("a", "b", "r"), ("a", "x", "r"), ("a", "x", "r"), ("y", "x", "s"), (None, "b", "r")], "src string, dst string, relation string")
    small = sorted(map(repr, hub.dangling(hub.Graph(nodes, edges)).collect()))
    monkeypatch.setattr(hub, "CARRIED", 0)
    assert sorted(map(repr, hub.dangling(hub.Graph(nodes, edges)).collect())) == small and len(small) == 5


def test_components_label_nodes_once(spark, monkeypatch):
    """No table of all nodes is walked in each round; labels are those of a union-find, over several rounds."""
    import random

    from quern.operators import merge

    rng, seen, keep = random.Random(4), [], merge.cut
    monkeypatch.setattr(merge, "cut", lambda df: (seen.append(df.columns), keep(df))[1])
    pairs = [(f"n{rng.randrange(60):02}", f"n{rng.randrange(60):02}") for _ in range(40)] + [(f"m{k:02}", f"m{k * 7 % 31:02}") for k in range(31)] + [("z", None), ("q", "q")]
    root = {x: x for p in pairs if None not in p for x in p}
    for _ in root:
        for x, y in pairs:
            if y is not None:
                root[x] = root[y] = min(root[x], root[y])
    want = sorted((x, r) for x, r in root.items() if any(x in p and p[0] != p[1] for p in pairs))
    frame = spark.createDataFrame(pairs, "a string, b string")
    assert sorted(map(tuple, merge.components(frame).collect())) == want
    assert ["node"] not in seen
    assert merge.components(frame.where("a = b")).columns == ["node", "component"] and merge.components(frame.where("a = b")).count() == 0


def test_patterns_go_to_the_triples(spark):
    """Names, relations and the types asked for are carried to the edges; what they find is what select() finds."""
    from quern.operators import hub, pattern

    nodes = spark.createDataFrame([("1", "ann", "Person"), ("2", "bo", "Person"), ("3", "oslo", "City"), ("4", "x", "Thing")], "id string, name string, type string")
    edges = spark.createDataFrame([("1", "lives_in", "3"), ("2", "lives_in", "3"), ("1", "knows", "2"), ("1", "knows", "2"), ("4", "in", "9"), ("1", "has", "4")], "src string, relation string, dst string")
    g = hub.Graph(nodes, edges)
    said = ["MATCH (p:Person {name: 'ann'})-[:LIVES_IN]->(c:City)", "MATCH (p {name: 'ann'})-[r]->(q)", "MATCH (a)-[:knows|in]->(b)", "MATCH (a:Person)-->(b:City)", "MATCH (p:Person {name: 'nobody'})-->(q:Person)", "MATCH (a)-->(b)"]
    found = pattern.select_each(g, spark.createDataFrame(list(enumerate(said)), "qid int, pattern string"))
    for k, one in enumerate(said):
        assert sorted(tuple(r)[1:] for r in found.where(f"qid = {k}").collect()) == sorted(map(tuple, pattern.select(g, one).collect())), one
    assert "strategy=broadcast" in found._jdf.queryExecution().optimizedPlan().toString()


def test_graphml_files_are_bounded(spark, tmp_path, monkeypatch):
    """No file has more than LINES rows, each is whole, and nothing is lost at their borders."""
    from quern.operators.hub import Graph
    from quern.sources import graphs

    monkeypatch.setattr(graphs, "LINES", 10)
    nodes = spark.range(0, 53, 1, 2).selectExpr("cast(id as string) as id", "'t' as type", "concat('n', id) as name")
    edges = spark.range(0, 16, 1, 1).selectExpr("cast(id as string) as src", "cast(id + 1 as string) as dst", "'r' as relation", "1.5D as weight")
    graphs.write_graphml(Graph(nodes, edges), str(tmp_path / "g"))
    sizes = [r["n"] for r in spark.read.text(str(tmp_path / "g")).groupBy("_metadata.file_path").count().withColumnRenamed("count", "n").collect()]
    assert max(sizes) <= 11 and len(sizes) >= 9  # the head is one row of two lines
    back = graphs.read_graphml(spark, str(tmp_path / "g"))
    assert sorted(r["id"] for r in back.nodes.collect()) == sorted(str(k) for k in range(53)) and back.edges.count() == 16
    assert back.nodes.where("type = 't' and name = concat('n', id)").count() == 53
    for f in (tmp_path / "g").glob("*.txt"):
        assert f.read_text().count("<graphml") == f.read_text().count("</graphml>") == 1


def test_contexts_are_found_once(spark, monkeypatch):
    """The nodes around the anchors are written once and read for lines, heads and tails."""
    from quern.operators import anchors, hub

    kept, cut = [], anchors.cut
    monkeypatch.setattr(anchors, "cut", lambda df: (kept.append(df.columns), cut(df))[1])
    nodes = spark.createDataFrame([("1", "ann", "p"), ("2", "bo", "p")], "id string, name string, type string")
    edges = spark.createDataFrame([("1", "2", "knows", 1.0)], "src string, dst string, relation string, weight double")
    lines, ids = anchors.answer_contexts(hub.Graph(nodes, edges), spark.createDataFrame([(7, "1")], "qid int, id string"))
    assert {r["context"] for r in lines.collect()} == {"p ann", "p bo", "1 -[knows]-> 2"} and ids.count() == 2
    assert kept == [["qid", "id", "rank"]]


def test_small_frontiers_go_to_the_edges(spark, monkeypatch):
    """Anchors, frontiers and their ends are carried to the edges; the paths and nodes are the same without."""
    from quern.operators import bridges, hub, traverse

    nodes = spark.createDataFrame([(c,) for c in "abcdef"], "id string")
    edges = spark.createDataFrame([("a", "b", 2.0), ("b", "c", 1.0), ("a", "d", 3.0), ("d", "c", 2.0), ("b", "d", 5.0), ("c", "e", 1.0)], "src string, dst string, weight double")
    g, pairs = hub.Graph(nodes, edges), spark.createDataFrame([("q", "a", "c"), ("q", "a", "e"), ("r", "f", "a")], "qid string, a string, b string")
    seeds = spark.createDataFrame([("q", "a"), ("r", "f")], "qid string, id string")
    went, carried = [], bridges.carried

    def both(kept):
        for module in (bridges, traverse):
            monkeypatch.setattr(module, "carried", lambda df: (went.append(df.columns), carried(df) if kept else df)[1])
        return sorted(map(repr, bridges.bridges(g, pairs).collect())), *[sorted(map(repr, part.collect())) for part in traverse.khop(g, seeds, 2, 3)]

    found = both(True)
    assert ["qid", "src"] in went and ["src"] in went and ["lo"] in went and ["anchor", "path", "end", "strength"] in went
    assert both(False) == found and any("a>d>c>e" in r for r in found[0]) and len(found[1]) == 4
