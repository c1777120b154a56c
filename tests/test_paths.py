"""Bridges, facts over time and graphs built in batches, against brute force."""

import random
from collections import defaultdict
from datetime import datetime, timedelta
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from quern.operators import bridges as B
from quern.operators.hub import Graph
from quern.operators.ontology import OntologyGraph
from quern.streaming import temporal as S


def graph_of(spark, edges, more=()):
    nodes = sorted({x for e in edges for x in e[:2]} | set(more))
    return Graph(spark.createDataFrame([(n, "t", n) for n in nodes], "id string, type string, name string"), spark.createDataFrame(edges, "src string, dst string, relation string, weight double"))


def all_paths(edges, a, b, longest):
    """Every loopless path of up to `longest` edges, by trying all orders of nodes."""
    weight = {}
    for x, y, _, w in edges:
        if x != y:
            for k in ((x, y), (y, x)):
                weight[k] = max(w, weight.get(k, 0))
    rest = sorted({x for k in weight for x in k} - {a, b})
    for n in range(longest):
        for middle in permutations(rest, n):
            path = (a, *middle, b)
            steps = list(zip(path, path[1:]))
            if a != b and all(s in weight for s in steps):
                yield len(steps), -min(weight[s] for s in steps), ">".join(path)


@pytest.mark.parametrize("seed", range(4))
def test_bridges_are_the_best_of_all_paths(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(8)]
    edges = [(rng.choice(names), rng.choice(names), "r", float(rng.randint(1, 5))) for _ in range(14)] + [("hub", n, "r", 1.0) for n in names]
    pairs = [("q1", *rng.sample(names, 2)) for _ in range(6)] + [("q2", "hub", "n0"), ("q2", "n1", "n1"), ("q2", "n1", "none")]
    for longest, most in ((1, 5), (2, 2), (3, 5), (4, 4)):
        got = B.bridges(graph_of(spark, edges), spark.createDataFrame(pairs + pairs[:2], "qid string, a string, b string"), longest, most).collect()
        want = [(q, a, b, path, n, -w, k + 1) for q, a, b in set(pairs) for k, (n, w, path) in enumerate(sorted(all_paths(edges, a, b, longest))[:most])]
        assert sorted(tuple(r) for r in got) == sorted(want)


def test_no_pairs_no_bridges(spark):
    g = graph_of(spark, [("a", "b", "r", 1.0)])
    assert B.bridges(g, spark.createDataFrame([], "qid string, a string, b string")).collect() == []


T0 = datetime(2024, 1, 1)
FACT = "entity string, attribute string, ts timestamp_ntz, fact_id long, value double"


def facts_of(seed, n):
    rng = random.Random(seed)
    return [(f"e{int(rng.random() ** 3 * 4)}", rng.choice("ab"), T0 + timedelta(minutes=rng.randrange(60)), i, rng.choice([None, 1.0, 2.0, 3.0])) for i in range(n)]


def by_key(rows):
    out = defaultdict(list)
    for e, a, ts, i, v in sorted(rows, key=lambda r: (r[2], r[3])):
        out[e, a].append((ts, i, v))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_history_by_hand(spark, seed):
    rows = facts_of(seed, 400)
    facts = spark.createDataFrame(rows, FACT).repartition(5)
    assert {tuple(r) for r in S.newest(facts).collect()} == {(*k, *v[-1]) for k, v in by_key(rows).items()}
    want = set()
    for k, v in by_key(r for r in rows if r[4] is not None).items():
        changes = [x for n, x in enumerate(v) if not n or v[n - 1][2] != x[2]]
        want |= {(*k, x[2], x[0], (changes[n + 1 :] or [(None,)])[0][0], n + 1 == len(changes)) for n, x in enumerate(changes)}
    assert {tuple(r) for r in S.timeline(facts).collect()} == want
    asked = [(i, f"e{i % 5}", T0 + timedelta(minutes=i % 70 - 3)) for i in range(100)]
    got = defaultdict(list)
    for r in S.as_of(facts, spark.createDataFrame(asked, "qid long, entity string, ts timestamp_ntz")).orderBy("qid", "rank").collect():
        got[r["qid"]].append((r["attribute"], r["value"], r["ts"]))
    for qid, entity, ts in asked:
        known = [(max((x for x in v if x[0] <= ts), key=lambda x: x[:2], default=None), k[1]) for k, v in by_key(rows).items() if k[0] == entity]
        assert got[qid] == [(a, x[2], x[0]) for x, a in sorted((x, a) for x, a in known if x)]


def test_empty_history(spark):
    none = spark.createDataFrame([], FACT)
    assert S.newest(none).count() == S.timeline(none).count() == S.as_of(none, spark.createDataFrame([], "qid long, entity string, ts timestamp_ntz")).count() == 0


def test_aged_scores(spark):
    hits = [(1, i, 1.0, T0 - timedelta(days=d)) for i, d in enumerate((0, 7, 14, -3))]
    got = {r["id"]: (r["weighted"], r["rank"]) for r in S.aged(spark.createDataFrame(hits, "qid long, id long, score double, ts timestamp_ntz"), F.lit(T0), 7.0).collect()}
    assert got == {0: (1.0, 2), 1: (0.5, 3), 2: (0.25, 4), 3: (1.0, 1)}


def test_stream_with_late_rows_goes_on_from_its_checkpoint(spark, tmp_path):
    rows = [r for r in facts_of(9, 300) if r[4] is not None]
    at, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    facts = lambda: S.read_facts(spark, at, FACT, list(map(F.col, ("entity", "attribute", "ts", "fact_id", "value"))), files=1)

    def feed(part):
        spark.createDataFrame(part, FACT).coalesce(1).write.mode("append").parquet(at)

    newest_first = sorted(rows, key=lambda r: r[2], reverse=True)
    feed(newest_first[:100])
    feed(newest_first[50:150])  # repeated and late ones
    S.stream_newest(facts(), out, checkpoint).awaitTermination()
    seen = newest_first[:150]
    state = lambda: {tuple(r) for r in S.newest(spark.read.schema(S.CHANGE).parquet(out)).collect()}
    assert state() == {(*k, *v[-1]) for k, v in by_key(seen).items()}
    written = spark.read.schema(S.CHANGE).parquet(out).count()
    S.stream_newest(facts(), out, checkpoint).awaitTermination()  # nothing new
    assert spark.read.schema(S.CHANGE).parquet(out).count() == written
    feed(newest_first[150:])
    feed([("e0", "a", T0 + timedelta(days=9), 10**6, 7.0), ("new", "z", None, 1, 1.0)])
    S.stream_newest(facts(), out, checkpoint).awaitTermination()
    every = rows + [("e0", "a", T0 + timedelta(days=9), 10**6, 7.0)]
    assert state() == {(*k, *v[-1]) for k, v in by_key(every).items()}
    last = spark.read.schema(S.CHANGE).parquet(out).where("fact_id = 1000000").first()
    assert last["changes"] >= 2 and last["late"] > 0  # the state of the first run is still there


def test_stream_keeps_one_state_for_each_entity(spark, tmp_path):
    """A call and a row of state for each entity, not for each of its attributes; changes are still counted by attribute."""
    rows = [r for r in facts_of(11, 240) if r[4] is not None] + [("e0", "far", datetime(2400, 1, 1), 10**7, 1.0), ("e1", None, T0, 10**7 + 1, None), ("e1", "none", T0, 10**7 + 2, None)]
    at, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[:100], rows[100:]):
        spark.createDataFrame(part, FACT).coalesce(1).write.mode("append").parquet(at)
    facts = S.read_facts(spark, at, FACT, list(map(F.col, ("entity", "attribute", "ts", "fact_id", "value"))), files=1)
    stream = S.stream_newest(facts, out, str(tmp_path / "checkpoint"))
    stream.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in stream.recentProgress if p["stateOperators"]]
    assert max(held) == len({r[0] for r in rows})
    first, both = by_key(rows[:100]), by_key(rows)
    want = {(*k, *v[-1], 1 + (k in first and first[k][-1] != v[-1])) for k, v in both.items()}
    written = spark.read.schema(S.CHANGE).parquet(out)
    last = written.groupBy("entity", "attribute").agg(F.max_by(F.struct("ts", "fact_id", "value", "changes"), F.struct("ts", "fact_id")).alias("x")).select("entity", "attribute", "x.*")
    assert {tuple(r) for r in last.collect()} == want


def triples_of(seed, n):
    rng = random.Random(seed)
    return [(f"s{rng.randrange(30)}", rng.choice(["A", "B", "C", None]), rng.choice(["r1", "r2", None]), f"o{rng.randrange(10)}", rng.choice("XY"), i) for i in range(n)]


TRIPLE = "subject string, subject_type string, relation string, object string, object_type string, pos long"


def built_by_hand(rows, total, mode, least, patience):
    """Nodes and edges with the round they came in, whether known, and the schema's size after each round."""
    size = max(1, int(total * 0.1))
    rounds = -(-total // size)
    nodes, edges, schema, idle, sizes = {}, {}, set(), 0, []
    for k in range(1, rounds + 1):
        batch = [r for r in rows if (k - 1) * size <= r[5] < k * size and r[2] is not None]
        seen = defaultdict(int)
        for s, st, rel, o, ot, _ in batch:
            seen[rel, st, ot] += 1
        if mode == "learned" and k == 1 or mode == "evolved" and k <= max(1, int(rounds * 0.5)) and (patience is None or idle < patience):
            new = {x for x, n in seen.items() if n >= (1 if mode == "learned" else least)} - schema
            idle = 0 if new else idle + 1
            schema |= new
        sizes.append(len(schema))
        types = defaultdict(set)
        known = defaultdict(bool)
        for s, st, rel, o, ot, _ in batch:
            types[s] |= {st} - {None}
            types[o] |= {ot}
            known[s, o, rel] |= (rel, st, ot) in schema
        for x, t in types.items():
            nodes.setdefault(x, (min(t, default=None), k))
        for e, ok in known.items():
            edges.setdefault(e, (ok, k))
    return nodes, edges, sizes, rounds


@pytest.mark.parametrize("mode, patience, n", [("evolved", None, 95), ("evolved", 1, 200), ("learned", None, 60), ("fixed", None, 7)])
def test_ontology_round_by_round(spark, tmp_path, mode, patience, n):
    rows = triples_of(n, n)
    triples = spark.createDataFrame(rows, TRIPLE)
    graph = OntologyGraph(spark, str(tmp_path), mode, patience=patience)
    rounds = graph.build(triples, "pos", n)
    nodes, edges, sizes, want = built_by_hand(rows, n, mode, 2, patience)
    assert rounds == want
    assert {r["id"]: (r["type"], r["round"]) for r in graph.nodes().collect()} == nodes
    assert {(r["src"], r["dst"], r["relation"]): (r["known"], r["round"]) for r in graph.edges().collect()} == edges
    state = graph.rounds(rounds).orderBy("round").collect()
    assert [r["relations"] for r in state] == sizes
    assert [r["nodes"] for r in state] == [sum(k <= i for _, k in nodes.values()) for i in range(1, rounds + 1)]
    assert [(r["new_edges"], r["new_known"]) for r in state] == [(sum(k == i for _, k in edges.values()), sum(ok and k == i for ok, k in edges.values())) for i in range(1, rounds + 1)]
    # At once: the same nodes and edges.
    whole = OntologyGraph(spark, str(tmp_path / "whole"))
    whole.insert(triples, 1)
    assert {r["id"] for r in whole.nodes().collect()} == set(nodes) and whole.edges().count() == len(edges)
    # The last round again, as after a failure: nothing changes.
    size = max(1, int(n * 0.1))
    graph.insert(triples.where(F.col("pos") >= (rounds - 1) * size), rounds)
    assert graph.nodes().count() == len(nodes) and graph.edges().count() == len(edges)


def test_ontology_given_schema(spark, tmp_path):
    graph = OntologyGraph(spark, str(tmp_path), "fixed")
    graph.start(spark.createDataFrame([("r1", "A", "X")], "relation string, head_type string, tail_type string"))
    graph.insert(spark.createDataFrame([("a", "A", "r1", "x", "X", 0), ("b", "B", "r1", "x", "X", 1)], TRIPLE), 1)
    assert {r["src"]: r["known"] for r in graph.edges().collect()} == {"a": True, "b": False} and graph.schema().count() == 1
    assert graph.graph().edges.count() == 2
    with pytest.raises(ValueError):
        OntologyGraph(spark, str(tmp_path), "other")


def test_anchors_grow_once(spark, monkeypatch):
    """A hundred pairs at one supplier share the paths from it."""
    edges = [(f"o{i}", f"p{i % 7}", "r", 1.0 + i) for i in range(40)] + [(f"p{i}", "s", "r", 1.0) for i in range(7)] + [(f"o{i}", f"c{i % 10}", "r", 1.0) for i in range(40)]
    graph = Graph(spark.createDataFrame([(n, "t", n) for e in edges for n in e[:2]], "id string, type string, name string").distinct(), spark.createDataFrame(edges, "src string, dst string, relation string, weight double"))
    pairs = spark.createDataFrame([(f"q{i}", f"c{i % 10}", "s") for i in range(100)], "qid string, a string, b string")
    grown, sizes = B._grown, []

    def watched(paths, near):
        out = grown(paths, near)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(B, "_grown", watched)
    got = B.bridges(graph, pairs).collect()
    assert sorted(sizes) == [7, 40]  # the supplier's parts and the customers' orders
    for q in range(100):
        c, mine = f"c{q % 10}", [r for r in got if r["qid"] == f"q{q}"]
        want = sorted((-min(1.0, 1.0 + i), f"{c}>o{i}>p{i % 7}>s") for i in range(40) if i % 10 == q % 10)[:5]
        assert [r["path"] for r in sorted(mine, key=lambda r: r["rank"])] == [p for _, p in want]
