"""Queries over deduplication, set operations and similarity merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import as_double
from ..operators import merge as U
from ..operators.lineage import cut
from ..sources.tables import load
from .registry import query


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by market segment and nation: many mentions of few entities."""
    c = load(spark, sf_dir, "customer")
    return c.select(
        F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"),
        F.create_map(F.lit("balance"), F.col("c_acctbal").cast("string"), F.concat(F.lit("k"), F.col("c_custkey") % 4), F.col("c_name")).alias("properties"), F.array("c_name").alias("aliases"),
        (F.col("c_custkey") % 10 / 10.0).alias("confidence"), F.when(F.col("c_custkey") % 2 == 0, "a").otherwise("b").alias("source"), F.col("c_custkey").alias("pos"),
    )


_PROPERTIES = """string_agg('k' || k || '=' || name, ',' ORDER BY k) FROM (SELECT c_mktsegment || '-' || c_nationkey AS id, c_custkey % 4 AS k, arg_max(c_name, c_custkey) AS name FROM customer GROUP BY 1, 2) x"""


@query(f"""SELECT c_mktsegment || '-' || c_nationkey AS id, 'balance=' || arg_max(CAST(c_acctbal AS VARCHAR), c_custkey) || ',' || (SELECT {_PROPERTIES} WHERE x.id = c_mktsegment || '-' || c_nationkey) AS properties, arg_max(c_name, c_custkey % 10 * 1000000000 - c_custkey) AS name, c_mktsegment AS type, count(*) AS merged,
count(DISTINCT c_name)::INT AS n_aliases, max(c_custkey % 10 / 10.0)::DOUBLE AS confidence, string_agg(DISTINCT CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'b' END, '+' ORDER BY CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'b' END) AS source
FROM customer GROUP BY c_mktsegment, c_nationkey""")
def entity_dedup_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions merged into entities: the most confident names them."""
    found = U.merge_entities(_entities(spark, sf_dir))
    listed = F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select("id", F.array_join(listed, ",").alias("properties"), "name", "type", "merged", F.size("aliases").alias("n_aliases"), "confidence", "source")


def _supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as mentions of a part's supplier."""
    return load(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("P"), F.col("l_partkey")).alias("src"), F.lit("supplied_by").alias("relation"), F.concat(F.lit("S"), F.col("l_suppkey")).alias("dst"),
        F.col("l_quantity").cast("double").alias("confidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
    )


@query("""SELECT 'P' || l_partkey AS src, 'supplied_by' AS relation, 'S' || l_suppkey AS dst, max(l_quantity)::DOUBLE AS confidence, min(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem GROUP BY l_partkey, l_suppkey""")
def relation_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated relations, the most confident kept."""
    return U.dedup_relations(_supplies(spark, sf_dir))


@query("""WITH u AS (SELECT DISTINCT p_type AS name, 'part ' || p_type AS definition, 0 AS side FROM part WHERE p_size < 25 UNION ALL SELECT DISTINCT p_type, 'any ' || p_type, 1 FROM part)
SELECT name, arg_min(definition, side) AS definition, count(*) AS seen FROM u GROUP BY name""")
def schema_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of type definitions, the first of a name winning."""
    p = load(spark, sf_dir, "part")
    named = lambda df, word: df.select(F.col("p_type").alias("name"), F.concat(F.lit(word), "p_type").alias("definition")).distinct()
    return U.merge_schemas(named(p.where("p_size < 25"), "part "), named(p, "any "))


_PAIRS = """WITH RECURSIVE p AS (SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 9) AS sim FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id),
k AS (SELECT * FROM p WHERE sim >= 0.38)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.similar_entities(load(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id"), "embedding", 0.38)


@query(_PAIRS + "SELECT a, b, round(sim, 6) AS sim FROM k")
def sim_pairs_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors in a cosine band."""
    return _pairs(spark, sf_dir).select("a", "b", F.round("sim", 6).alias("sim"))


_GROUPS = _PAIRS + """, both_ways AS (SELECT a AS u, b AS v FROM k UNION SELECT b, a FROM k),
reach AS (SELECT u AS node, least(u, v) AS c FROM both_ways UNION SELECT e.u, r.c FROM both_ways e JOIN reach r ON e.v = r.node),
g AS (SELECT node, min(c) AS component FROM reach GROUP BY node)"""


@query(_GROUPS + " SELECT node, component FROM g")
def merge_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar pairs closed to groups."""
    return U.components(_pairs(spark, sf_dir))


@query(_GROUPS + """, d AS (SELECT u AS node, count(*) AS degree FROM both_ways GROUP BY u),
o AS (SELECT node, component, row_number() OVER (PARTITION BY component ORDER BY degree DESC, node) AS nth FROM g JOIN d USING (node))
SELECT g.node, g.component, o.node AS canonical FROM g JOIN o ON o.component = g.component AND nth = 1""")
def canonical_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group's member of highest degree."""
    pairs = cut(_pairs(spark, sf_dir))  # found once, for groups and degrees
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return U.canonical(U.components(pairs), ends)


_TYPES = """WITH t AS (SELECT 't' || label AS type, list(m ORDER BY i) AS tv FROM (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label),
s AS (SELECT vec_id AS id, type, round(list_cosine_similarity(embedding::DOUBLE[], tv), 9) AS sim FROM embeddings, t),
best AS (SELECT id, type, sim FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY sim DESC, type) = 1)"""


def _best_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = load(spark, sf_dir, "embeddings")
    means = v.select("label", F.posexplode(as_double(F.col("embedding"))).alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    sorted_means = F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"])
    types = means.groupBy("label").agg(sorted_means.alias("v")).select(F.concat(F.lit("t"), F.col("label").cast("string")).alias("type"), "v")
    return U.best_types(v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), types, 0.1)


@query(_TYPES + " SELECT id, type, round(sim, 6) AS sim FROM best WHERE sim >= 0.1")
def type_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest type of each vector."""
    return _best_types(spark, sf_dir).select("id", "type", F.round("sim", 6).alias("sim"))


@query("""WITH n AS (SELECT DISTINCT p_name AS name FROM part), s AS (SELECT name, list_distinct(regexp_extract_all(lower(name), '(?s).')) AS s FROM n),
p AS (SELECT x.name AS a, y.name AS b, CASE WHEN contains(lower(x.name), lower(y.name)) OR contains(lower(y.name), lower(x.name)) THEN 0.9
ELSE len(list_intersect(x.s, y.s))::DOUBLE / len(list_distinct(list_concat(x.s, y.s))) END AS sim FROM s x JOIN s y ON x.name < y.name) SELECT a, b, round(sim, 6)::DOUBLE AS sim FROM p WHERE sim >= 0.3""")
def string_sim_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names that are alike by their characters."""
    names = load(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return U.similar_names(names, 0.3).select("a", "b", F.round("sim", 6).alias("sim"))


@query(_TYPES + ", p AS (SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 9) AS sim FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id) SELECT a, b, u.type, round(p.sim, 6) AS sim FROM p JOIN best u ON u.id = a JOIN best w ON w.id = b WHERE p.sim >= 0.38 AND u.type = w.type AND u.sim >= 0.1 AND w.sim >= 0.1")
def typed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar pairs whose nearest types agree."""
    return U.typed_pairs(_pairs(spark, sf_dir), _best_types(spark, sf_dir)).withColumn("sim", F.round("sim", 6))


_MERGED = """WITH c AS (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS g FROM customer),
n AS (SELECT c_mktsegment || '-' || c_nationkey AS id, arg_max(c_name, c_custkey % 10 * 100000000000 - g * 10000000000 - c_custkey) AS name, count(*) AS merged, max(c_custkey % 10 / 10.0)::DOUBLE AS confidence FROM c GROUP BY 1)"""


@query(_MERGED + " SELECT * FROM n")
def graph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of two graphs in one: the most confident mention names a node, the first graph's before the second's."""
    e, edges = _entities(spark, sf_dir), _supplies(spark, sf_dir)
    second = F.col("pos") % 3 == 0
    nodes, _ = U.merge_graphs([e.where(~second), e.where(second)], [edges.where(~second), edges.where(second)])
    return nodes.select("id", "name", "merged", "confidence")


@query("""WITH l AS (SELECT *, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN (l_orderkey * 10 + l_linenumber) % 3 = 0 THEN 1 ELSE 0 END AS graph FROM lineitem)
SELECT 'P' || l_partkey AS src, 'S' || l_suppkey AS dst, max(l_quantity)::DOUBLE AS confidence, min(graph)::INT AS graph, arg_min(pos, (graph, pos))::BIGINT AS pos FROM l GROUP BY l_partkey, l_suppkey""")
def graph_merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of two graphs in one."""
    e, edges = _entities(spark, sf_dir), _supplies(spark, sf_dir)
    second = F.col("pos") % 3 == 0
    return U.merge_graphs([e.where(~second), e.where(second)], [edges.where(~second), edges.where(second)])[1].select("src", "dst", "confidence", "graph", "pos")


@query("""WITH a AS (SELECT DISTINCT p_type AS name FROM part WHERE p_size < 25), b AS (SELECT DISTINCT upper(p_type) AS name FROM part WHERE p_size > 2 UNION SELECT DISTINCT p_brand FROM part)
SELECT name, 'added' AS change FROM b WHERE lower(name) NOT IN (SELECT lower(name) FROM a) UNION ALL SELECT name, 'removed' FROM a WHERE lower(name) NOT IN (SELECT lower(name) FROM b)""")
def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one list of types has that another one lacks, case ignored."""
    p = load(spark, sf_dir, "part")
    new = p.where("p_size > 2").select(F.upper("p_type").alias("name")).unionByName(p.select(F.col("p_brand").alias("name"))).distinct()
    return U.schema_changes(p.where("p_size < 25").select(F.col("p_type").alias("name")).distinct(), new)


@query("""WITH d AS (SELECT 'O' || l_orderkey AS grp, l_returnflag || ' of ' || l_suppkey % 7 AS description, min(l_linenumber) AS pos FROM lineitem GROUP BY 1, 2)
SELECT grp, string_agg(description, ' | ' ORDER BY pos, description) AS description FROM d GROUP BY grp""")
def description_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct descriptions of each order's lines in order of first sight."""
    line = load(spark, sf_dir, "lineitem")
    rows = line.select(F.concat(F.lit("O"), "l_orderkey").alias("grp"), F.concat("l_returnflag", F.lit(" of "), F.col("l_suppkey") % 7).alias("description"), F.col("l_linenumber").alias("pos"))
    return U.merge_descriptions(rows, "grp")


@query()
def kmeans_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector nearest to each of eight cluster centres."""
    return U.representatives(load(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8)
