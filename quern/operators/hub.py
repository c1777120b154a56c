"""The graph hub: a graph is a pair of DataFrames, nodes (id, type, name, ...) and edges (src, dst, relation, weight).

Conversions from other shapes, constraints, filters and neighbourhoods.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import load
from .lineage import cut
from .sizes import CARRIED, bytes_of, carried, dealt


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame


def trade_graph(spark: SparkSession, sf_dir: str, orders: bool = True) -> Graph:
    """The base tables as a graph: ids carry their table's letter."""
    t = lambda name: load(spark, sf_dir, name)
    tag = lambda letter, c: F.concat(F.lit(f"{letter}:"), F.col(c).cast("string"))

    def node(df: DataFrame, letter: str, key: str, kind: str, name: str) -> DataFrame:
        return df.select(tag(letter, key).alias("id"), F.lit(kind).alias("type"), F.col(name).cast("string").alias("name"))

    def edge(df: DataFrame, a: str, ka: str, b: str, kb: str, relation: str, weight: Column | None = None) -> DataFrame:
        w = F.lit(1.0) if weight is None else weight.cast("double")
        return df.select(tag(a, ka).alias("src"), tag(b, kb).alias("dst"), F.lit(relation).alias("relation"), w.alias("weight"))

    line = t("lineitem")
    nodes = [
        node(t("region"), "R", "r_regionkey", "region", "r_name"),
        node(t("nation"), "N", "n_nationkey", "nation", "n_name"),
        node(t("customer"), "C", "c_custkey", "customer", "c_name"),
        node(t("supplier"), "S", "s_suppkey", "supplier", "s_name"),
        node(t("part"), "P", "p_partkey", "part", "p_name"),
    ]
    lines = line.count()  # from the files' footers
    supplied = dealt(line, lines, "l_partkey", "l_suppkey").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("w"))
    edges = [
        edge(t("nation"), "N", "n_nationkey", "R", "n_regionkey", "in_region"),
        edge(t("customer"), "C", "c_custkey", "N", "c_nationkey", "in_nation"),
        edge(t("supplier"), "S", "s_suppkey", "N", "s_nationkey", "in_nation"),
        edge(supplied, "P", "l_partkey", "S", "l_suppkey", "supplied_by", F.col("w")),
    ]
    if orders:
        bought = dealt(line, lines, "l_orderkey").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("w"))
        nodes.append(node(t("orders"), "O", "o_orderkey", "order", "o_orderkey"))
        edges.append(edge(t("orders"), "O", "o_orderkey", "C", "o_custkey", "placed_by"))
        edges.append(edge(bought, "O", "l_orderkey", "P", "l_partkey", "contains", F.col("w")))
    union = lambda parts: parts[0] if len(parts) == 1 else union([parts[0].unionByName(parts[1]), *parts[2:]])
    return Graph(union(nodes), union(edges))


# Shapes and conversions


def from_dicts(nodes: DataFrame, edges: DataFrame) -> Graph:
    """Node rows (id, name, pos, ...) and edge rows (source, target, pos, ...) as a graph.

    A node's id is its id or else its name; nodes without either and edges
    without both ends are dropped; of repeated ids or ends the last row wins.
    """
    key = F.coalesce(F.col("id").cast("string"), F.col("name").cast("string"))
    keyed = nodes.withColumn("id", key).where("id is not null")
    last = keyed.groupBy("id").agg(F.max_by(F.struct(*[c for c in keyed.columns if c != "id"]), "pos").alias("n")).select("id", "n.*")
    ends = edges.withColumnsRenamed({"source": "src", "target": "dst"}).where("src is not null and dst is not null")
    rest = [c for c in ends.columns if c not in ("src", "dst")]
    kept = ends.groupBy("src", "dst").agg(F.max_by(F.struct(*rest), "pos").alias("e")).select("src", "dst", "e.*")
    return Graph(last, kept)


def from_triplets(triplets: DataFrame) -> Graph:
    """Rows (subject, relation, object) as a graph; ends become nodes of type Entity, a missing relation RELATED_TO."""
    edges = triplets.where("subject is not null and object is not null").select(
        F.col("subject").alias("src"), F.col("object").alias("dst"), F.coalesce("relation", F.lit("RELATED_TO")).alias("relation"), F.lit(1.0).alias("weight")
    )
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return Graph(ends.select("id", F.lit("Entity").alias("type"), F.col("id").alias("name")), edges)


def to_triplets(graph: Graph) -> DataFrame:
    return graph.edges.select(F.col("src").alias("subject"), "relation", F.col("dst").alias("object"))


_CONVERTERS: dict[str, Callable[..., Graph]] = {"dict": from_dicts, "triplets": from_triplets}


def register_format(name: str, converter: Callable[..., Graph]) -> None:
    _CONVERTERS[name] = converter


def convert(form: str, *source: DataFrame) -> Graph:
    """Any registered shape to the hub."""
    if form not in _CONVERTERS:
        raise ValueError(f"unknown graph format {form!r}; known: {', '.join(sorted(_CONVERTERS))}")
    return _CONVERTERS[form](*source)


# Filters, constraints and conformance


def relation_triples(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat_ws("|", "src", "relation", "dst").alias("triple"), "weight")


def inverse(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"src": F.col("dst"), "dst": F.col("src"), "relation": F.concat(F.lit("inverse_"), "relation")})


def violations(nodes: DataFrame) -> DataFrame:
    """Rows of `nodes` that break a constraint, with the reason: id, name and type filled, confidence within [0, 1]."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    reason = F.when(blank("id"), "empty id").when(blank("name"), "empty name").when(blank("type"), "empty type")
    if "confidence" in nodes.columns:
        reason = reason.when(~F.col("confidence").between(0, 1), "confidence out of range")
    return nodes.withColumn("reason", reason).where("reason is not null")


def dangling(graph: Graph) -> DataFrame:
    """One row for each missing end of an edge.

    Nodes that are too many to travel with the tasks meet the distinct ends,
    and what is missing of these goes to the edges; no whole edge is shuffled
    for an end that is there.
    """
    ids = graph.nodes.select(F.col("id").alias("end"))
    out = graph.edges.select("src", "dst", "relation", F.explode(F.array(
        F.struct(F.lit("head").alias("side"), F.col("src").alias("end")), F.struct(F.lit("tail").alias("side"), F.col("dst").alias("end"))
    )).alias("e")).select("src", "dst", "relation", "e.*")
    shown = lambda df: df.select("src", "dst", "relation", "side", F.col("end").alias("missing"))
    if bytes_of(ids) <= CARRIED:
        return shown(out.join(F.broadcast(ids), "end", "left_anti"))
    missing = cut(out.where("end is not null").select("end").distinct().join(ids, "end", "left_anti"))
    return shown(out.join(carried(missing), "end", "left_semi")).unionByName(shown(out.where("end is null")))


def valid_edges(graph: Graph) -> DataFrame:
    ids = graph.nodes.select("id")
    return graph.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def isolated(graph: Graph) -> DataFrame:
    ends = graph.edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return graph.nodes.join(ends, "id", "left_anti")


def conformance(graph: Graph, allowed: DataFrame) -> DataFrame:
    """Edges with whether their relation is in `allowed` (relation, head_types, tail_types) and their ends' types fit.

    An empty list of types allows any; an unknown node has type ''.
    """
    types = graph.nodes.select("id", "type")
    typed = (
        graph.edges.join(types.withColumnsRenamed({"id": "src", "type": "head_type"}), "src", "left")
        .join(types.withColumnsRenamed({"id": "dst", "type": "tail_type"}), "dst", "left")
        .join(allowed, "relation", "left")
    )
    head, tail = F.coalesce("head_type", F.lit("")), F.coalesce("tail_type", F.lit(""))
    fits = lambda listed, t: (F.size(listed) == 0) | F.array_contains(F.col(listed), t)
    ok = F.col("head_types").isNotNull() & fits("head_types", head) & fits("tail_types", tail)
    return typed.select("src", "dst", "relation", head.alias("head_type"), tail.alias("tail_type"), ok.alias("valid"))


# Neighbourhoods


def both_ways(edges: DataFrame, keep: bool = False) -> DataFrame:
    """Each undirected edge in both directions: src, dst, weight (the largest of repeated ones).

    Edges are grouped in one direction and turned afterwards; with `keep` that one is written to the checkpoint folder.
    """
    one = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("weight").alias("weight"))
    one = cut(one) if keep else one
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def neighbours(edges: DataFrame, direction: str = "both") -> DataFrame:
    """Distinct (id, neighbour) pairs along outgoing, incoming or all edges."""
    out = edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbour"))
    into = edges.select(F.col("dst").alias("id"), F.col("src").alias("neighbour"))
    return {"out": out, "in": into, "both": out.unionByName(into)}[direction].distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """Edge ends for each node: id, degree."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def induced(graph: Graph, seeds: DataFrame, hops: int) -> Graph:
    """What lies within `hops` of the seeds (column id): nodes and the edges between them."""
    near = neighbours(graph.edges)
    seen = seeds.select("id").distinct().join(graph.nodes.select("id"), "id", "left_semi")
    for _ in range(hops):
        seen = seen.unionByName(seen.join(near, "id").select(F.col("neighbour").alias("id"))).distinct()
    nodes = graph.nodes.join(seen, "id", "left_semi")
    edges = graph.edges.join(seen.withColumnRenamed("id", "src"), "src", "left_semi").join(seen.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return Graph(nodes, edges)


# Statistics and quality


def statistics(nodes: DataFrame) -> DataFrame:
    """Nodes by type: type, n, and the share of all."""
    by = nodes.groupBy(F.coalesce("type", F.lit("UNKNOWN")).alias("type")).agg(F.count("*").alias("n"))
    return by.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def relation_statistics(edges: DataFrame, confidence: str) -> DataFrame:
    """Edges by relation, the most first (place): relation, n, the share of all, the mean of `confidence` (nulls skipped), place."""
    by = edges.groupBy(F.coalesce("relation", F.lit("UNKNOWN")).alias("relation")).agg(F.count("*").alias("n"), F.avg(confidence).alias("mean"))
    every = Window.partitionBy()  # over the relations
    return by.withColumns({"share": F.col("n") / F.sum("n").over(every), "place": F.row_number().over(every.orderBy(F.desc("n"), "relation"))})


def unknown_types(nodes: DataFrame, allowed: DataFrame) -> DataFrame:
    """Nodes whose type is missing or none of `allowed` (type), case ignored; an empty schema allows all."""
    known = allowed.select(F.lower(F.trim("type")).alias("__t")).distinct()
    return nodes.join(known, F.lower(F.trim("type")) == F.col("__t"), "left_anti").join(known.limit(1).select(F.lit(1).alias("__some")), F.lit(True), "left_semi")


def type_names(names: DataFrame, reserved: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """Suggested type names (name, pos) that may be types: trimmed, neither too special nor reserved, each once (case
    counts) at its first place, the first `most` of them: name, pos."""
    from ..functions.text import over_specific, present

    kept = names.select(present(F.col("name")).alias("name"), "pos").where(F.col("name").isNotNull() & ~over_specific(F.col("name")))
    if reserved:
        kept = kept.where(~F.lower("name").isin([r.lower() for r in reserved]))
    first = kept.groupBy("name").agg(F.min("pos").alias("pos"))
    return first if most is None else first.orderBy("pos", "name").limit(most)


def density(n: Column, m: Column, directed: bool = False) -> Column:
    most = n * (n - 1) / (1.0 if directed else 2.0)
    return F.when(n > 1, F.round(m / most, 6)).otherwise(0.0)


def clustering(edges: DataFrame) -> DataFrame:
    """id, degree, triangles and coefficient of every node with an edge.

    Triangles are found once, along edges from the end of smaller degree on, so
    that a hub contributes its neighbours' few pairs and not all pairs of its
    own. Each such edge asks with the third nodes (higher still) of whichever
    end has fewer of them, and only if both ends have some.
    """
    pairs = both_ways(edges, keep=True)
    deg = cut(pairs.groupBy("src").agg(F.count("*").alias("degree")).withColumnRenamed("src", "id"))
    rank = lambda c: F.struct(f"{c}_degree", c)
    once = pairs.where("src < dst").select("src", "dst")
    ranked = once.join(deg.withColumnsRenamed({"id": "src", "degree": "src_degree"}), "src").join(deg.withColumnsRenamed({"id": "dst", "degree": "dst_degree"}), "dst")
    rises = rank("src") < rank("dst")
    up = cut(ranked.select(F.when(rises, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(rises, F.col("dst")).otherwise(F.col("src")).alias("b"), F.greatest("src_degree", "dst_degree").alias("d")))
    out = up.groupBy("a").agg(F.count("*").alias("n"))
    sized = cut(up.join(out, "a").join(out.withColumnsRenamed({"a": "b", "n": "m"}), "b").select("a", "b", "d", "n", "m"))  # an end without third nodes closes nothing
    third = up.select(F.col("a").alias("k"), F.col("b").alias("c"), F.col("d").alias("e"))
    near = lambda end: sized.where("n < m" if end == "a" else "n >= m").join(third, F.col(end) == F.col("k")).where(F.struct("d", "b") < F.struct("e", "c")).select("a", "b", "c")
    closed = (
        near("a").join(up.select(F.col("a").alias("b"), F.col("b").alias("c")), ["b", "c"], "left_semi").select("a", "b", "c")
        .unionByName(near("b").join(up.select("a", F.col("b").alias("c")), ["a", "c"], "left_semi").select("a", "b", "c"))
    )
    per = closed.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
    d = F.col("degree")
    t = F.coalesce("triangles", F.lit(0))
    value = F.when(d > 1, 2.0 * t / (d * (d - 1))).otherwise(0.0)
    return deg.join(per, "id", "left").select("id", "degree", t.alias("triangles"), value.alias("coefficient"))


def quality(graph: Graph, components: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, degrees, components, the largest one's share, orphans and mean clustering.

    `components` gives a component for each node with an edge. An empty graph gives zeros.
    """
    n = graph.nodes.agg(F.count("*").alias("nodes"))
    m = graph.edges.agg(F.count("*").alias("edges"))
    deg = degrees(graph.edges)
    joined = graph.nodes.select("id").join(deg, "id", "left").agg(
        F.coalesce(F.round(F.avg(F.coalesce("degree", F.lit(0))), 4), F.lit(0.0)).alias("avg_degree"),
        F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"),
        F.count(F.when(F.col("degree").isNull(), 1)).alias("orphans"),
    )
    sizes = components.groupBy("component").agg(F.count("*").alias("size")).agg(F.count("*").alias("joined"), F.coalesce(F.max("size"), F.lit(0)).alias("largest"))
    total = clustering(graph.edges).agg(F.coalesce(F.sum("coefficient"), F.lit(0.0)).alias("clustered"))
    row = n.crossJoin(m).crossJoin(joined).crossJoin(sizes).crossJoin(total)  # five single rows
    nodes = F.col("nodes")
    share = lambda c: F.when(nodes > 0, F.round(c / nodes, 4)).otherwise(0.0)
    return row.select(
        "nodes", "edges", density(nodes, F.col("edges")).alias("density"), "avg_degree", "max_degree",
        (F.col("joined") + F.col("orphans")).alias("components"),
        share(F.greatest("largest", F.least(nodes, F.lit(1)))).alias("largest_ratio"),
        "orphans", share(F.col("orphans")).alias("orphan_ratio"), share(F.col("clustered")).alias("avg_clustering"),
    )


def property_schema(rows: DataFrame, label: str, properties: str) -> DataFrame:
    """The sorted property keys of each label."""
    keys = rows.select(F.col(label).alias("label"), F.explode(F.map_keys(properties)).alias("k"))
    return keys.groupBy("label").agg(F.array_join(F.array_sort(F.collect_set("k")), ",").alias("keys"))


def vocabulary(graph: Graph) -> DataFrame:
    """The types of a graph's nodes and the relations of its edges, the most frequent first: kind, name, n, place (from 1 in each kind)."""
    names = graph.nodes.select(F.lit("type").alias("kind"), F.col("type").alias("name")).unionByName(graph.edges.select(F.lit("relation").alias("kind"), F.col("relation").alias("name")))
    counted = names.groupBy("kind", "name").agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "name")))  # a row for each name
