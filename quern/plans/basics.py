"""Queries over single operators: parsing, ordering, sampling, scaling and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import hub as H
from ..operators import reports as P
from ..operators import retrieve as R
from ..sources.records import metadata_entities, metadata_triples
from ..sources.tables import load
from .merges import _entities
from .registry import query

_SOURCES = "'chunk-' || event_id % 50 || '<SEP> chunk-' || user_id || '<SEP>x'"


@query(f"""WITH n AS (SELECT event_type AS qid, 0 AS s, value AS v, 'n' || event_id AS n, {_SOURCES} AS src FROM events WHERE event_id % 2 = 0
UNION ALL SELECT event_type, 1, user_id::DOUBLE, 'a' || event_id || '|b' || user_id, {_SOURCES} FROM events WHERE event_id % 2 = 1),
l AS (SELECT qid, s, v, n, unnest(['chunk-' || regexp_extract(src, 'chunk-(\\d+)<SEP>', 1), trim(regexp_extract(src, '<SEP> (chunk-\\d+)', 1))]) AS id, unnest([0, 1]) AS pos FROM n),
f AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY qid, id ORDER BY s, v DESC, n DESC, pos) = 1)
SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY s, v DESC, n DESC, pos)::INT AS rank FROM f""")
def retrieved_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk ids in the order in which nodes and edges bring them."""
    e = load(spark, sf_dir, "events")
    c = lambda n: F.col(n).cast("string")
    source = F.concat(F.lit("chunk-"), (F.col("event_id") % 50).cast("string"), F.lit("<SEP> chunk-"), c("user_id"), F.lit("<SEP>x")).alias("source_id")
    nodes = e.where("event_id % 2 = 0").select(F.col("event_type").alias("qid"), F.concat(F.lit("n"), c("event_id")).alias("name"), F.col("value").alias("score"), source)
    edges = e.where("event_id % 2 = 1").select(F.col("event_type").alias("qid"), F.concat(F.lit("b"), c("user_id")).alias("src"), F.concat(F.lit("a"), c("event_id")).alias("dst"), F.col("user_id").alias("weight"), source)
    return R.retrieved_ids(nodes, edges)


@query("""WITH r AS (SELECT conv_id, role, md5(text) AS t, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS place FROM conversations)
SELECT a.conv_id, a.place::INT AS place, a.t AS a, b.t AS b FROM r a JOIN r b ON a.conv_id = b.conv_id AND a.place = b.place WHERE a.role = 'user' AND b.role = 'assistant'""")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-th question of a conversation beside its n-th answer."""
    c = load(spark, sf_dir, "conversations").withColumn("t", F.md5("text"))
    return R.zipped(c.where("role = 'user'"), c.where("role = 'assistant'"), "conv_id", "turn", "t")


@query("SELECT doc_id, substring(text, 1, 1500) AS text FROM documents ORDER BY doc_id LIMIT 20")
def head_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The beginnings of the first twenty documents."""
    return R.head_sample(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", 20, 1500)


@query("""WITH e AS (SELECT CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS a, user_id::DOUBLE AS b FROM events)
SELECT count(*) AS n, round(avg(a), 6) AS a, round(avg(b), 6) AS b, min(a) AS least, max(a) AS most, round(avg((a IS NOT NULL)::INT), 6) AS success FROM e""")
def benchmark_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means, range and success of scores, some of which are NaN."""
    e = load(spark, sf_dir, "events")
    rows = e.select(F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("a"), F.col("user_id").cast("double").alias("b"))
    return P.benchmark_stats(rows, ["a", "b"], "a")


@query("""SELECT c_mktsegment AS label, string_agg(DISTINCT k, ',' ORDER BY k) AS keys FROM (SELECT c_mktsegment, unnest(['balance', 'k' || c_custkey % 4]) AS k FROM customer) GROUP BY c_mktsegment""")
def property_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The property names of each label."""
    return H.property_schema(_entities(spark, sf_dir), "type", "properties")


@query("""WITH u AS (SELECT DISTINCT p_type AS type FROM part), s AS (SELECT DISTINCT p_type AS type FROM part WHERE p_size < 10),
k AS (SELECT 'P' || p_partkey AS id FROM part WHERE p_size < 40), r AS (SELECT 'P' || l_partkey AS src, 'P' || l_suppkey AS dst FROM lineitem)
SELECT (SELECT avg((type IN (SELECT type FROM s))::INT) FROM u) AS coverage, (SELECT least(1.0, avg(len(regexp_split_to_array(type, '[\\s_]+'))) / 3) FROM u)::DOUBLE AS specificity,
  (SELECT avg((src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k))::INT) FROM r) AS coherence""")
def schema_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage, specificity and coherence of a schema."""
    part, line = load(spark, sf_dir, "part"), load(spark, sf_dir, "lineitem")
    tag = lambda c: F.concat(F.lit("P"), F.col(c).cast("string"))
    types = part.select(F.col("p_type").alias("type"), "p_size", tag("p_partkey").alias("id"))
    relations = line.select(tag("l_partkey").alias("src"), tag("l_suppkey").alias("dst"))
    return P.schema_scores(types, types.where("p_size < 10"), relations, types.where("p_size < 40"))


@query("""WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'I think: ["' || event_type || '", "u' || user_id || '"] done' WHEN 1 THEN '[]' WHEN 2 THEN 'none' ELSE '["' || event_type || '"]' END AS t FROM events)
SELECT event_id, CASE event_id % 4 WHEN 0 THEN (SELECT event_type || '|u' || user_id FROM events x WHERE x.event_id = e.event_id) WHEN 3 THEN (SELECT event_type FROM events x WHERE x.event_id = e.event_id) ELSE '' END AS items,
  CASE WHEN event_id % 3 = 0 THEN 'true,false,false' ELSE 'false,true,true' END AS flags FROM e""")
def json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lists out of a model's answer, as strings and as three booleans."""
    k, c = F.col("event_id") % 4, lambda n: F.col(n).cast("string")
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    answer = (
        F.when(k == 0, F.concat(F.lit("I think: ["), quoted(c("event_type")), F.lit(", "), quoted(F.concat(F.lit("u"), c("user_id"))), F.lit("] done")))
        .when(k == 1, "[]").when(k == 2, "none").otherwise(F.concat(F.lit("["), quoted(c("event_type")), F.lit("]")))
    )
    flags = F.when(F.col("event_id") % 3 == 0, F.lit("so [true]")).otherwise(F.lit("[false, true, true, false]"))
    joined = lambda x: F.array_join(x.cast("array<string>"), ",")
    return load(spark, sf_dir, "events").select("event_id", F.array_join(T.json_list(answer), "|").alias("items"), joined(T.bool_list(flags, F.lit(3))).alias("flags"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN trim(text) WHEN turn % 3 = 1 THEN role || chr(10) || trim(text) ELSE '' END AS answer FROM conversations""")
def answer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers from a text, a list of texts, or neither."""
    k = F.col("turn") % 3
    rows = load(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", T.answer_text(F.when(k == 0, F.col("text")), F.when(k == 1, F.array("role", F.lit("  "), "text"))).alias("answer"))


@query("""SELECT event_id, round(CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 0 END, 6)::DOUBLE AS scaled FROM events WINDOW w AS (PARTITION BY event_type)""")
def min_max_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values scaled to [0, 1] within their kind."""
    rows = R.scaled(load(spark, sf_dir, "events").select("event_id", "event_type", "value"), "event_type", "value")
    return rows.select("event_id", F.round("scaled", 6).alias("scaled"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN value ELSE user_id END::DOUBLE AS score FROM events""")
def finite_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers out of text; words, NaN and infinities are none."""
    k = F.col("event_id") % 5
    raw = F.when(k == 0, "NaN").when(k == 1, F.when(F.col("event_id") % 2 == 0, "Infinity").otherwise("none")).when(k == 2, F.col("value").cast("string")).otherwise(F.col("user_id").cast("string"))
    return load(spark, sf_dir, "events").select("event_id", T.finite(raw).alias("score"))


@query("""SELECT p_partkey, substring(CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_name || chr(10) || p_type END, 1, 20) AS embedded FROM part""")
def embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What entities are embedded by, cut."""
    description = F.when(F.col("p_size") % 3 != 0, F.col("p_type")).otherwise(F.lit("  "))
    return load(spark, sf_dir, "part").select("p_partkey", T.embed_text(F.col("p_name"), description, 20).alias("embedded"))


@query("""WITH d AS (SELECT conv_id AS qid, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS section, turn AS rank, text || '<SEP>rest' AS description FROM conversations WHERE trim(text) <> '' AND role <> 'system')
SELECT qid, section::INT AS section, rank, md5(split_part(description, '<SEP>', 1)) AS context FROM d QUALIFY row_number() OVER (PARTITION BY qid, description ORDER BY section, rank) = 1""")
def context_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context lines of nodes and edges: whole descriptions once, first segments shown."""
    c = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("rank"), F.when(F.trim("text") != "", F.concat("text", F.lit("<SEP>rest"))).alias("description"), "role")
    lines = R.contexts(c.where("role = 'user'").drop("role"), c.where("role = 'assistant'").drop("role"))
    return lines.withColumn("context", F.md5("context"))


@query("""SELECT o_orderkey AS no, floor((row_number() OVER (ORDER BY o_orderkey) - 1) / greatest(1, floor((SELECT count(*) FROM orders) * 0.1::DOUBLE)))::INT AS batch FROM orders""")
def positional_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by place in ten batches (and a rest)."""
    orders = load(spark, sf_dir, "orders")
    placed = R.running_sums(orders.select(F.lit(0).alias("g"), "o_orderkey", F.lit(1).alias("one")), "g", "o_orderkey", "one")
    return P.batches(placed.withColumn("pos", F.col("nth") - 1), "pos", orders.count()).select(F.col("o_orderkey").alias("no"), "batch")


def _record_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    engineer = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority"))
    meta = T.metadata_map({"NO": F.col("o_orderkey"), "Customer": F.col("c_name"), "Engineers": engineer})
    return rows.select(F.col("o_orderkey").cast("string").alias("doc_id"), F.lit("").alias("text"), meta.alias("metadata"))


_RECORD = "WITH r AS (SELECT o_orderkey::VARCHAR AS id, c_name AS customer, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS engineer FROM orders JOIN customer ON o_custkey = c_custkey)"


@query(_RECORD + " SELECT 'Record_' || id AS subject, 'BELONGS_TO' AS relation, customer AS object FROM r UNION ALL SELECT engineer, 'HANDLED', 'Record_' || id FROM r WHERE engineer IS NOT NULL")
def ontology_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of records' metadata."""
    return metadata_triples(_record_docs(spark, sf_dir))


@query(_RECORD + " SELECT id AS doc_id, 0 AS pos, customer AS entity FROM r UNION ALL SELECT id, 1, engineer FROM r WHERE engineer IS NOT NULL")
def document_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities that records' metadata name."""
    return metadata_entities(_record_docs(spark, sf_dir))
