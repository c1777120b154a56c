"""Graph queries without SQL against brute force."""

import heapq
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quern.operators import hub, merge, pattern, retrieve, sizes, traverse
from quern.plans import catalogue


def test_kg_quality_whole_graph(spark, sf_dir):
    got = catalogue.queries()["kg_quality"](spark, sf_dir).first()
    graph = hub.trade_graph(spark, sf_dir)
    nodes, edges = ([tuple(r) for r in df.collect()] for df in (graph.nodes.select("id"), graph.edges.select("src", "dst")))
    tables = ("region", "nation", "customer", "supplier", "part", "orders")
    assert got["nodes"] == len(nodes) == sum(spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in tables)
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    seen, sizes = set(), []
    for (start,) in nodes:
        todo, size = [start] if start not in seen else [], 0
        seen.add(start)
        while todo:
            x = todo.pop()
            size += 1
            todo += (new := near[x] - seen)
            seen |= new
        sizes += [size] * (size > 0)
    linked = sum(sum(b in near[a] for a, b in combinations(s, 2)) / (len(s) * (len(s) - 1) / 2) for s in list(near.values()) if len(s) > 1)
    assert (got["edges"], got["components"], got["orphans"]) == (len(edges), len(sizes), sum(not near[i] for (i,) in nodes))
    assert got["largest_ratio"] == pytest.approx(max(sizes) / len(nodes), abs=1e-4)
    assert got["avg_clustering"] == pytest.approx(linked / len(nodes), abs=1e-4)


def test_large_line_tables_are_dealt_to_more_tasks(spark, sf_dir, monkeypatch):
    """What a task groups stays the same however many lines there are, and so do the edges and degrees."""
    rows = lambda df: sorted(map(tuple, df.collect()))
    plain = hub.trade_graph(spark, sf_dir).edges
    edges, degrees = rows(plain), rows(hub.degrees(plain))
    monkeypatch.setattr(sizes.dealt, "__kwdefaults__", {"each": 200})
    graph = hub.trade_graph(spark, sf_dir).edges
    assert (rows(graph), rows(hub.degrees(graph))) == (edges, degrees)
    for relation in ("supplied_by", "contains"):
        tasks = [r["count"] for r in graph.where(F.col("relation") == relation).groupBy(F.spark_partition_id()).count().collect()]
        assert len(tasks) > 20 and max(tasks) < 400


def cheapest(near, start, within=None):
    """Least costs from one node, over all nodes or some."""
    best, todo = {}, [(0.0, start)]
    while todo:
        cost, x = heapq.heappop(todo)
        if x in best:
            continue
        best[x] = cost
        for y, w in near[x].items():
            if y not in best and (within is None or y in within):
                heapq.heappush(todo, (cost + 1 / max(w, 0.01), y))
    return best


def weighted(spark, sf_dir):
    near = defaultdict(dict)
    for r in hub.trade_graph(spark, sf_dir).edges.collect():
        for a, b in ((r["src"], r["dst"]), (r["dst"], r["src"])):
            near[a][b] = max(r["weight"], near[a].get(b, 0.0))
    return near


def test_steiner_paths_are_cheapest(spark, sf_dir):
    near = weighted(spark, sf_dir)
    graph = hub.trade_graph(spark, sf_dir)
    rows = [("x", f"S:{k}", k) for k in (1, 4, 6)] + [("y", "C:3", 0), ("y", "P:7", 1), ("y", "nowhere", 2)] + [("z", "O:1", 0)]
    got = traverse.steiner(graph, spark.createDataFrame(rows, "qid string, id string, rank int")).collect()
    for qid, want in (("x", ["S:1", "S:4", "S:6"]), ("y", ["C:3", "P:7"]), ("z", ["O:1"])):
        mine = {r["id"]: r["role"] for r in got if r["qid"] == qid}
        tree = {i for i, role in mine.items() if role != "padding"}
        assert [i for i in want if mine.get(i) == "terminal"] == want and sum(r == "terminal" for r in mine.values()) == len(want)
        for k, end in enumerate(want[1:], 1):
            whole, inside = cheapest(near, end), cheapest(near, end, tree)
            assert min(inside.get(s, 1e9) for s in want[:k]) == pytest.approx(min(whole[s] for s in want[:k]))
        assert len(mine) <= 20


def test_pagerank_settles(spark, sf_dir):
    """The settled walk against a plain power iteration from an even start."""
    near, graph = weighted(spark, sf_dir), hub.trade_graph(spark, sf_dir)
    nodes = [r["id"] for r in graph.nodes.select("id").collect()]
    seeds = spark.createDataFrame([(1, "S:1", 0.5), (1, "C:2", 0.25)], "qid int, id string, score double")
    got = {r["id"]: r["value"] for r in traverse.pagerank(graph, seeds, tolerance=1e-9).collect()}
    pull = {"S:1": 2 / 3, "C:2": 1 / 3}
    value = {i: 1 / len(nodes) for i in nodes}
    total = {i: sum(max(w, 0.01) for w in near[i].values()) for i in nodes}
    for _ in range(150):
        new = {i: 0.15 * pull.get(i, 0.0) for i in nodes}
        for i in nodes:
            for j, w in near[i].items():
                new[j] += 0.85 * value[i] * max(w, 0.01) / total[i]
            if not near[i]:
                for s, p in pull.items():
                    new[s] += 0.85 * value[i] * p
        value = new
    assert max(abs(value[i] - got.get(i, 0.0)) for i in nodes) < 1e-4


def test_representatives_are_nearest(spark, sf_dir):
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    got = catalogue.queries()["kmeans_representatives"](spark, sf_dir).collect()
    assert len({r["cluster"] for r in got}) == len(got) == 8 and all(r["id"] in rows and r["distance"] >= 0 for r in got)


def test_pattern_mentions():
    said = pattern.mentions("MATCH (a:Person {name: 'Ann'})-[r:KNOWS|:LIKES*1..2]->(b:`City`) WHERE b.name IN ['X', \"Y\"] OR b.name CONTAINS 'Z' RETURN a")
    assert said == pattern.Mentions(("Ann", "Z", "X", "Y"), ("Person", "City"), ("KNOWS", "LIKES"))


def test_pattern_cascade(spark):
    nodes = spark.createDataFrame([("1", "Person", "Ann"), ("2", "Person", "Bob"), ("3", "City", "X")], "id string, type string, name string")
    edges = spark.createDataFrame([("1", "2", "knows", 1.0), ("1", "3", "lives_in", 1.0)], "src string, dst string, relation string, weight double")
    found = lambda p: sorted(map(tuple, pattern.select(hub.Graph(nodes, edges), p).collect()))
    assert found("(a {name: 'Ann'})-[:KNOWS]->(b)") == [("1", "knows", "2")]
    assert found("(a:Person)-[:HATES]->(b:Person)") == [("1", "knows", "2")]  # nothing so narrow: by the labels
    assert found("(a:City)-->(b:City)") == found("RETURN 1") == []


def test_hub_shapes(spark):
    nodes = spark.createDataFrame([(None, "Node1", 0), ("id2", "Node2", 1), (None, None, 2), ("id2", "again", 3)], "id string, name string, pos int")
    edges = spark.createDataFrame([("Node1", "id2", "r", 0), ("Node1", None, "r", 1), ("Node1", "id2", "last", 2)], "source string, target string, relation string, pos int")
    g = hub.convert("dict", nodes, edges)
    assert sorted((r["id"], r["name"]) for r in g.nodes.collect()) == [("Node1", "Node1"), ("id2", "again")]
    assert [(r["src"], r["dst"], r["relation"]) for r in g.edges.collect()] == [("Node1", "id2", "last")]
    triples = spark.createDataFrame([("a", "knows", "b"), ("a", None, "c"), (None, "x", "y")], "subject string, relation string, object string")
    g = hub.convert("triplets", triples)
    assert sorted(map(tuple, hub.to_triplets(g).collect())) == [("a", "RELATED_TO", "c"), ("a", "knows", "b")] and g.nodes.count() == 3
    with pytest.raises(ValueError, match="unknown graph format"):
        hub.convert("neo", triples)
    bad = spark.createDataFrame([("1", "n", "t", 0.5), (" ", "n", "t", 0.5), ("2", "", "t", 0.5), ("3", "n", None, 0.5), ("4", "n", "t", 1.5)], "id string, name string, type string, confidence double")
    assert sorted(r["reason"] for r in hub.violations(bad).collect()) == ["confidence out of range", "empty id", "empty name", "empty type"]


def test_similar_entity_merge(spark):
    g = hub.Graph(
        spark.createDataFrame([(i, "T", i) for i in "abcd"], "id string, type string, name string"),
        spark.createDataFrame([("a", "c", "r", 1.0), ("b", "c", "r", 2.0), ("a", "d", "s", 1.0), ("a", "b", "r", 5.0)], "src string, dst string, relation string, weight double"),
    )
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.99, 0.05]), ("c", [0.0, 1.0]), ("d", [0.5, 0.5])], "id string, v array<double>")
    merged, names = merge.merge_similar(g, vectors, 0.9)
    assert sorted((r["node"], r["canonical"]) for r in names.collect()) == [("a", "a"), ("b", "a")]
    assert sorted(r["id"] for r in merged.nodes.collect()) == ["a", "c", "d"]
    assert sorted((r["src"], r["dst"], r["relation"], r["weight"]) for r in merged.edges.collect()) == [("a", "c", "r", 3.0), ("a", "d", "s", 1.0)]
    assert merge.merge_similar(g, vectors, 0.9, gate=0.9)[1].collect() == []
    with pytest.raises(ValueError):
        merge.similar_entities(vectors, "v", 0.9, 0.5)


def test_auto_merge_and_endpoints(spark):
    docs = spark.createDataFrame([(1, "x" * 40)], "doc_id long, text string")
    chunks = retrieve.hierarchical_chunks(docs, (16, 8, 4))
    hits = spark.createDataFrame([("q", 1, 0, 1.0), ("q", 1, 1, 0.5), ("q", 1, 4, 0.9)], "qid string, doc_id long, chunk int, score double")
    got = sorted((r["level"], r["chunk"], r["score"]) for r in retrieve.auto_merge(hits, chunks).collect())
    assert got == [(1, 0, 0.75), (2, 4, 0.9)]
    rel = spark.createDataFrame([("q", "a", "b", 1), ("q", "b", "c", 2)], "qid string, src string, dst string, rank int")
    assert [(r["id"], r["rank"]) for r in retrieve.endpoints(rel, 2).orderBy("rank").collect()] == [("a", 1), ("b", 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_khop_takes_little_of_a_hub(spark, monkeypatch, seed):
    """Two and three hops around several seeds give what a search by hand gives; what lies behind a hub is not written for each query."""
    import random

    from quern.operators import traverse
    from quern.operators.hub import Graph

    rng = random.Random(seed)
    spokes = [(f"n{i:03}", "hub") for i in range(150)]
    pairs = spokes + [(f"n{rng.randrange(40):03}", f"m{rng.randrange(12):02}") for _ in range(60)] + [("lone", "lone")]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set())
        if a != b:
            near[a].add(b), near.setdefault(b, set()).add(a)
    graph = Graph(spark.createDataFrame([(n,) for n in near], "id string"), spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, dst string, weight double"))
    seeds = [(f"q{i}", f"n{i:03}") for i in range(8)] + [("q0", "m01"), ("q1", "n005"), ("q9", "lone"), ("q10", "missing")]
    written, cut = [], traverse.cut
    monkeypatch.setattr(traverse, "cut", lambda df: written.append(cut(df)) or written[-1])
    for hops, top in ((1, 3), (2, 4), (3, 300)):
        written.clear()
        nodes, edges = traverse.khop(graph, spark.createDataFrame(seeds, "qid string, id string"), hops, top)
        got_nodes, got_edges = {}, {}
        for r in nodes.collect():
            got_nodes.setdefault(r["qid"], set()).add((r["id"], r["hop"], r["rank"]))
        rows = edges.collect()
        for r in rows:
            got_edges.setdefault(r["qid"], {})[r["a"], r["b"]] = (r["hop"], r["rank"])
        assert len(rows) == sum(map(len, got_edges.values()))
        for q in {q for q, _ in seeds}:
            hop = {n: 0 for k, n in seeds if k == q and n in near}
            for h in range(1, hops + 1):
                hop |= {m: h for n in [n for n, g in hop.items() if g == h - 1] for m in near[n] if m not in hop}
            best = sorted(hop, key=lambda n: (-len(near[n]), hop[n], n))[:top]
            assert got_nodes.get(q, set()) == {(n, hop[n], len(near[n])) for n in best}
            seen = {}
            for n, g in hop.items():
                for m in near[n] if g < hops else ():
                    seen[min(n, m), max(n, m)] = (min(g + 1, seen.get((min(n, m), max(n, m)), (99,))[0]), len(near[n]) + len(near[m]))
            assert got_edges.get(q, {}) == seen
        if hops == 2:
            assert max(df.count() for df in written if "qid" in df.columns) < 150


def test_clustering_asks_with_the_fewer(spark):
    """Random graphs with hubs: degrees and triangles as counted by hand."""
    import random
    from itertools import combinations

    from quern.operators import hub

    rng = random.Random(5)
    pairs = {tuple(sorted(rng.sample(range(25), 2))) for _ in range(90)} | {(i, 99) for i in range(25)} | {(50, 51), (51, 51)}
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(str(a), set()).add(str(b)), near.setdefault(str(b), set()).add(str(a))
    got = {r["id"]: (r["degree"], r["triangles"]) for r in hub.clustering(spark.createDataFrame([(str(a), str(b), 1.0) for a, b in pairs] * 2, "src string, dst string, weight double")).collect()}
    assert got == {n: (len(m), sum(y in near[x] for x, y in combinations(m, 2))) for n, m in near.items()}


def test_gate_within_groups(spark, monkeypatch):
    """The same as gating all pairs of a group, none of which is made first: pairs without common neighbours are not joined."""
    import random

    from quern.operators import merge
    from quern.operators.hub import Graph

    rng = random.Random(4)
    edges = spark.createDataFrame([(f"P{rng.randrange(30)}", f"S{rng.randrange(9)}", "r", 1.0) for _ in range(80)] + [("S1", "P2", "r", 1.0)], "src string, dst string, relation string, weight double")
    graph = Graph(spark.createDataFrame([("P1",)], "id string"), edges)
    rows = [(f"P{i}", i % 4, i) for i in range(36)] + [("P1", 1, 1)]
    pairs = spark.createDataFrame([(f"P{i}", f"P{j}") for i in range(36) for j in range(i + 1, 36) if i % 4 == j % 4], "a string, b string")
    found = lambda df: sorted((r["a"], r["b"], round(r["overlap"], 9)) for r in df.collect())
    for least in (0.02, 0.3, 0.6):
        got = found(merge.topology_gate_within(spark.createDataFrame(rows, "id string, group int, place int"), graph, least))
        assert got == found(merge.topology_gate(pairs, graph, least)) and len(got) > 30
    with pytest.raises(ValueError):
        merge.topology_gate_within(pairs, graph, 0.0)
