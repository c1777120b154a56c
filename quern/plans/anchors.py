"""Queries over anchors, filters, chunk graphs, planned filters and merges one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import anchors as A
from ..operators import merge as U
from ..operators import planner as L
from ..operators import retrieve as R
from ..operators.chunks import chunk_graph, vector_context
from ..operators.hub import Graph, trade_graph
from ..sources.tables import load
from .graphs import _G
from .merges import _entities, _supplies
from .registry import query


def _tag(letter: str, c: str):
    return F.concat(F.lit(f"{letter}:"), F.col(c).cast("string"))


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every hundredth order as a question that names its customer, then the suppliers of its lines; and the order as its document."""
    o = load(spark, sf_dir, "orders").where("o_orderkey % 100 = 0").select("o_orderkey", "o_custkey")
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.upper("c_name").alias("entity"))
    line = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_suppkey")
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit(" "), "s_name").alias("entity"))
    first = o.join(c, "o_custkey").select("o_orderkey", F.lit(0).alias("pos"), "entity")
    later = o.join(line, "o_orderkey").join(s, "l_suppkey").select("o_orderkey", F.col("l_linenumber").cast("int").alias("pos"), "entity")
    mentions = first.unionByName(later).withColumnRenamed("o_orderkey", "qid")
    return mentions, o.select(F.col("o_orderkey").alias("qid"), F.lit(0).alias("pos"), _tag("O", "o_orderkey").alias("id"))


_ANCHORS = """, m AS (SELECT o_orderkey AS qid, 0 AS pos, c_name AS entity FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 100 = 0
  UNION ALL SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_orderkey % 100 = 0),
f AS (SELECT qid, 0 AS part, pos, id FROM m JOIN nodes ON lower(name) = lower(entity) UNION ALL SELECT o_orderkey, 1, 0, 'O:' || o_orderkey FROM orders WHERE o_orderkey % 100 = 0),
a AS MATERIALIZED (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY part, pos, id)::INT AS rank FROM (SELECT qid, id, part, pos FROM f QUALIFY row_number() OVER (PARTITION BY qid, id ORDER BY part, pos) = 1))"""


def _anchored(spark: SparkSession, sf_dir: str) -> tuple[Graph, DataFrame]:
    graph = trade_graph(spark, sf_dir)
    mentions, documents = _asked(spark, sf_dir)
    return graph, A.anchors(mentions, graph.nodes.select("id", "name"), documents)


@query(_G + _ANCHORS + " SELECT * FROM a")
def anchor_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes that every hundredth order's names stand for, and the order itself behind them."""
    return _anchored(spark, sf_dir)[1]


_AROUND = _ANCHORS + """, nd AS (SELECT src AS id, count(*) AS degree FROM near GROUP BY src),
h AS (SELECT qid, id, 0 AS hop FROM a UNION ALL SELECT DISTINCT a.qid, dst, 1 FROM a JOIN near ON src = a.id ANTI JOIN a x ON x.qid = a.qid AND x.id = near.dst),
k AS MATERIALIZED (SELECT * FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY coalesce(degree, 0) DESC, hop, id) AS rank FROM h LEFT JOIN nd USING (id)) WHERE rank <= 20)"""


@query(_G + _AROUND + """, n AS (SELECT qid, 0 AS section, rank, type || ' ' || name AS context FROM k JOIN nodes USING (id)),
e AS (SELECT x.qid, 1 AS section, row_number() OVER (PARTITION BY x.qid ORDER BY weight DESC, src, relation, dst) AS rank, src || ' -[' || relation || ']-> ' || dst AS context FROM edges JOIN k x ON x.id = src JOIN k y ON y.qid = x.qid AND y.id = dst)
SELECT qid, section::INT AS section, rank::INT AS rank, context FROM (SELECT * FROM n UNION ALL SELECT * FROM e) QUALIFY row_number() OVER (PARTITION BY qid, context ORDER BY section, rank) = 1""")
def graph_answer_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context lines that every hundredth order gets from one step around its anchors."""
    graph, found = _anchored(spark, sf_dir)
    return A.answer_contexts(graph, found)[0]


@query(_G + _AROUND + " SELECT qid, id, rank::INT AS rank FROM k")
def graph_answer_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids behind these contexts, in order."""
    graph, found = _anchored(spark, sf_dir)
    return A.answer_contexts(graph, found)[1]


_MERGED = """WITH m AS (SELECT c_mktsegment || '-' || c_nationkey AS id, arg_max(c_name, c_custkey % 10 * 1000000000 - c_custkey) AS name, c_mktsegment AS type, max(c_custkey % 10 / 10.0)::DOUBLE AS confidence,
  string_agg(DISTINCT CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'b' END, '+' ORDER BY CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'b' END) AS source FROM customer GROUP BY c_mktsegment, c_nationkey)"""


@query(_MERGED + " SELECT id, 'type' AS filter FROM m WHERE type = 'BUILDING' UNION ALL SELECT id, 'source' FROM m WHERE contains(source, 'a') UNION ALL SELECT id, 'confidence' FROM m WHERE confidence >= 0.5 UNION ALL SELECT id, 'all' FROM m WHERE type = 'BUILDING' AND contains(source, 'a') AND confidence >= 0.5")
def entity_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged entities by type, by a part of their source, by confidence, and by all three."""
    found = U.merge_entities(_entities(spark, sf_dir))
    every = {"type": A.holds(type="BUILDING"), "source": A.holds("a"), "confidence": A.holds(least=0.5), "all": A.holds("a", 0.5, type="BUILDING")}
    named = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in every.items()]))  # one pass over the entities
    return found.select("id", F.explode(named).alias("filter"))


@query("""WITH e AS (SELECT 'P' || l_partkey AS src, 'S' || l_suppkey AS dst, max(l_quantity)::DOUBLE AS confidence FROM lineitem GROUP BY l_partkey, l_suppkey), i AS (SELECT 'P' || p_partkey AS id FROM part WHERE p_partkey % 100 = 0 UNION ALL SELECT 'S' || s_suppkey FROM supplier WHERE s_suppkey % 100 = 0)
SELECT src, dst, confidence FROM e WHERE confidence >= 25 AND (src IN (SELECT id FROM i) OR dst IN (SELECT id FROM i))""")
def relation_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confident relations that touch every hundredth part or supplier."""
    edges = U.dedup_relations(_supplies(spark, sf_dir)).where(A.holds(least=25.0, relation="supplied_by"))
    ids = lambda t, letter, c: load(spark, sf_dir, t).where(f"{c} % 100 = 0").select(F.concat(F.lit(letter), F.col(c).cast("string")).alias("id"))
    return A.touching(edges, ids("part", "P", "p_partkey").unionByName(ids("supplier", "S", "s_suppkey"))).select("src", "dst", "confidence")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN trim(p_type) WHEN 1 THEN p_name WHEN 2 THEN p_brand ELSE NULL END AS name, CASE p_partkey % 4 WHEN 1 THEN p_type WHEN 2 THEN p_brand ELSE '' END AS description FROM part WHERE p_partkey % 4 < 3""")
def schema_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types given as text or as objects of several spellings; blank ones are dropped."""
    k = F.col("p_partkey") % 4
    text = lambda **fields: F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    item = F.when(k == 0, F.concat(F.lit("  "), "p_type")).when(k == 1, text(name=F.col("p_name"), description=F.col("p_type"))).when(k == 2, text(label=F.col("p_brand"), desc=F.col("p_brand"))).otherwise(text(name=F.lit("  ")))
    found = load(spark, sf_dir, "part").select("p_partkey", A.schema_item(item).alias("i")).where("i is not null")
    return found.select("p_partkey", "i.name", "i.description")


_CHUNKS = """WITH s AS (SELECT unnest([0, 1, 2]) AS level, unnest([2048, 1024, 512]) AS size), c AS (SELECT doc_id, level, unnest(range(0, greatest(1, ceil(length(text) / size::DOUBLE)::INT))) AS chunk FROM documents, s),
e AS MATERIALIZED (SELECT doc_id || ':' || level || ':' || chunk AS src, 'parent' AS relation, doc_id || ':' || (level - 1) || ':' || (chunk // 2) AS dst FROM c WHERE level > 0
  UNION ALL SELECT doc_id || ':' || level || ':' || chunk, 'previous', doc_id || ':' || level || ':' || (chunk - 1) FROM c WHERE chunk > 0
  UNION ALL SELECT doc_id || ':' || level || ':' || (chunk - 1), 'next', doc_id || ':' || level || ':' || chunk FROM c WHERE chunk > 0)"""


@query(_CHUNKS + " SELECT * FROM e")
def chunk_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent, previous and next relations of all chunks."""
    return chunk_graph(R.hierarchical_chunks(load(spark, sf_dir, "documents"))).edges.drop("weight")


@query(_CHUNKS + """, b AS (SELECT src, relation, dst, src AS f, dst AS t FROM e UNION ALL SELECT src, relation, dst, dst, src FROM e),
h AS (SELECT doc_id AS qid, doc_id || ':2:0' AS id, 1.0 AS score FROM documents WHERE doc_id % 100 = 0 UNION ALL SELECT doc_id, doc_id || ':2:' || max(chunk), 0.5 FROM c WHERE level = 2 AND doc_id % 100 = 0 GROUP BY doc_id),
h0 AS (SELECT qid, id, max(score) AS score FROM h GROUP BY qid, id), t1 AS (SELECT qid, src, relation, dst, t, 1 AS hop, score FROM h0 JOIN b ON f = id),
h1 AS (SELECT t1.qid, t AS id, max(t1.score) AS score FROM t1 ANTI JOIN h0 ON h0.qid = t1.qid AND h0.id = t GROUP BY t1.qid, t), t2 AS (SELECT qid, src, relation, dst, t, 2 AS hop, score FROM h1 JOIN b ON f = id),
x AS (SELECT qid, src, relation, dst, hop, max(score) AS score FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2) GROUP BY qid, src, relation, dst, hop QUALIFY row_number() OVER (PARTITION BY qid, src, relation, dst ORDER BY hop) = 1)
SELECT qid, src, relation, dst, hop::INT AS hop, score::DOUBLE AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hop, score DESC, src, relation, dst) AS rank FROM x) WHERE rank <= 30""")
def chunk_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies within two steps of the first and last leaf of every hundredth document."""
    chunks = R.hierarchical_chunks(load(spark, sf_dir, "documents"))
    ends = chunks.where("level = 2 and doc_id % 100 = 0").groupBy("doc_id").agg(F.max("chunk").alias("last"))
    at = F.explode(F.array(F.struct(F.lit(0).alias("chunk"), F.lit(1.0).alias("score")), F.struct(F.col("last").alias("chunk"), F.lit(0.5).alias("score")))).alias("h")
    hits = ends.select("doc_id", at).select(F.col("doc_id").alias("qid"), F.concat_ws(":", "doc_id", F.lit("2"), "h.chunk").alias("id"), "h.score")
    return vector_context(chunk_graph(chunks), hits, depth=2)


_ASKED = "q AS (SELECT 'b' || item_id AS qid, text FROM benchmark UNION ALL SELECT conv_id || ':' || turn, text FROM conversations WHERE role = 'user')"


@query("WITH " + _ASKED + r""", w AS (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS key FROM q),
p AS (SELECT qid, 'lang' AS attribute, lang AS value FROM w JOIN (SELECT DISTINCT lang FROM documents) ON lang = key UNION ALL SELECT qid, 'source', source FROM w JOIN (SELECT DISTINCT source FROM documents) ON source = key),
k AS (SELECT qid, string_agg(attribute || '=' || value, ';' ORDER BY attribute || '=' || value) AS filters, list(value) FILTER (attribute = 'lang') AS langs, list(value) FILTER (attribute = 'source') AS sources FROM p GROUP BY qid)
SELECT qid, filters, (SELECT count(*) FROM documents WHERE (langs IS NULL OR list_contains(langs, lang)) AND (sources IS NULL OR list_contains(sources, source)))::BIGINT AS n FROM k""")
def self_query_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filters on language and source that each question of the benchmark and each user turn names, and how many documents pass."""
    benchmark = load(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("qid"), "text")
    turns = load(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws(":", "conv_id", "turn").alias("qid"), "text")
    docs = load(spark, sf_dir, "documents")
    plan = L.plans(benchmark.unionByName(turns), L.value_index(docs, ["lang", "source"]))
    return L.passing(plan, docs, ["lang", "source"])


def _chained(spark: SparkSession, sf_dir: str) -> tuple[Graph, DataFrame]:
    """Parts and their suppliers: parts of one brand, type and size are merged, and what is left of them by brand and name."""
    whole = trade_graph(spark, sf_dir, orders=False)
    graph = Graph(whole.nodes.where("type in ('part', 'supplier')"), whole.edges.where("relation = 'supplied_by'"))
    part = load(spark, sf_dir, "part").withColumn("node", _tag("P", "p_partkey"))

    def by(*columns: str):
        keyed = part.select("node", F.concat_ws("|", *columns).alias("component"))
        return lambda g: keyed.join(g.nodes.select(F.col("id").alias("node")), "node", "left_semi")

    return U.chained(graph, [by("p_brand", "p_type", "p_size"), by("p_brand", "p_name")])


_CHAIN = """WITH e0 AS (SELECT 'P:' || l_partkey AS src, 'S:' || l_suppkey AS dst, count(*)::DOUBLE AS weight FROM lineitem GROUP BY 1, 2), d0 AS (SELECT src AS node, count(*) AS d FROM e0 GROUP BY src),
p AS (SELECT 'P:' || p_partkey AS node, p_brand || '|' || p_type || '|' || p_size AS g1, p_brand || '|' || p_name AS g2 FROM part),
c1 AS MATERIALIZED (SELECT node, g2, first_value(node) OVER (PARTITION BY g1 ORDER BY coalesce(d, 0) DESC, node) AS c FROM p LEFT JOIN d0 USING (node)),
e1 AS MATERIALIZED (SELECT c AS src, dst, sum(weight) AS weight FROM e0 JOIN c1 ON node = src GROUP BY c, dst), d1 AS (SELECT src AS node, count(*) AS d FROM e1 GROUP BY src),
c2 AS MATERIALIZED (SELECT node, first_value(node) OVER (PARTITION BY g2 ORDER BY coalesce(d, 0) DESC, node) AS c FROM (SELECT DISTINCT x.c AS node, y.g2 FROM c1 x JOIN p y ON y.node = x.c) LEFT JOIN d1 USING (node))"""


@query(_CHAIN + " SELECT c1.node, c2.c AS canonical FROM c1 JOIN c2 ON c2.node = c1.c")
def chained_merge_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part that each part ends at after two merges."""
    return _chained(spark, sf_dir)[1]


@query(_CHAIN + " SELECT c AS src, dst, sum(weight)::DOUBLE AS weight FROM e1 JOIN c2 ON node = src GROUP BY c, dst")
def chained_merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges after two merges, weights added up."""
    return _chained(spark, sf_dir)[0].edges.select("src", "dst", "weight")
