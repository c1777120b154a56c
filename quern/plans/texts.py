"""Queries over scalar text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieve as R
from ..operators.hub import type_names
from ..sources.tables import load
from .registry import query


@query("SELECT doc_id, md5(trim(text)) AS context_id, length(text) AS n FROM documents")
def doc_hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-hash ids."""
    return load(spark, sf_dir, "documents").select("doc_id", T.context_id(F.col("text")).alias("context_id"), F.length("text").cast("long").alias("n"))


@query("SELECT md5(text) AS text_id, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY text")
def unique_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts with their first document."""
    docs = load(spark, sf_dir, "documents")
    keyed = docs.select(F.md5("text").alias("text_id"), F.length("text").alias("n"), "doc_id")  # 128 bits and a length stand for a text
    return keyed.groupBy("text_id", "n").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")).drop("n")


_RECORDS = """
WITH r AS (
  SELECT o_orderkey AS no, c_name AS customer, o_orderpriority AS engineers,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS start,
         o_orderstatus AS description
  FROM orders JOIN customer ON o_custkey = c_custkey)
"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    start = F.when(F.col("o_orderkey") % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("no"), F.col("c_name").alias("customer"), F.col("o_orderpriority").alias("engineers"),
        start.alias("start"), F.col("o_orderstatus").alias("description"),
    )


@query(_RECORDS + """
SELECT CAST(no AS VARCHAR) AS doc_id,
  concat_ws(chr(10), 'Customer: ' || customer, 'Engineers: ' || engineers, 'Service Start: ' || start, 'Description: ' || description) AS key_value,
  '# ' || customer || chr(10) || '- **Engineers**: ' || coalesce(engineers, 'N/A') || chr(10) || '- **Service Start**: ' || coalesce(start, 'N/A') AS markdown
FROM r""")
def text_formatters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maintenance records as key-value and markdown documents."""
    r = _records(spark, sf_dir)
    c = F.col
    return r.select(
        c("no").cast("string").alias("doc_id"),
        T.key_value_text({"Customer": c("customer"), "Engineers": c("engineers"), "Service Start": c("start"), "Description": c("description")}).alias("key_value"),
        T.markdown_text(c("customer"), {"Engineers": c("engineers"), "Service Start": c("start")}).alias("markdown"),
    )


@query(_RECORDS + """
SELECT no, (CASE WHEN start IS NULL THEN 2 ELSE 3 END)::BIGINT AS n_keys, '[RECORD_TIME: ' || coalesce(start, '') || '] ' || description AS stamped FROM r""")
def record_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata maps keep what is present; text gets its record time."""
    r = _records(spark, sf_dir)
    meta = T.metadata_map({"Customer": F.col("customer"), "Start": F.col("start"), "Description": F.col("description")})
    return r.select("no", F.size(meta).cast("long").alias("n_keys"), T.record_time(F.col("description"), F.coalesce("start", F.lit(""))).alias("stamped"))


_SCOPES = ("Single Hop", "multi_hop", "LOCAL", "2-hop", "1hop question", "unknown", "global view", "")


@query(f"""
WITH v AS (SELECT event_id, ({list(_SCOPES)!r})[(event_id % 8)::INT + 1] AS raw FROM events),
n AS (SELECT event_id, raw, replace(replace(lower(trim(raw)), '_', '-'), ' ', '') AS x FROM v)
SELECT event_id, raw, CASE
  WHEN x IN ('local','single-hop','singlehop','1-hop','1hop','hop1','one-hop') THEN 'local'
  WHEN x IN ('global','multi-hop','multihop','2-hop','2hop','hop2','two-hop') THEN 'global'
  WHEN contains(x,'single') OR contains(x,'local') OR x LIKE '1-%' OR x LIKE '1hop%' THEN 'local'
  WHEN contains(x,'multi') OR contains(x,'global') OR x LIKE '2-%' OR x LIKE '2hop%' THEN 'global'
  ELSE '' END AS scope FROM n""")
def qa_scope_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question scopes from free names."""
    names = F.array(*[F.lit(s) for s in _SCOPES])
    raw = F.element_at(names, (F.col("event_id") % 8 + 1).cast("int"))
    return load(spark, sf_dir, "events").select("event_id", raw.alias("raw"), T.qa_scope(raw).alias("scope"))


@query("""
WITH v AS (SELECT event_id, ' d' || user_id || ',' || chr(10) || ' d' || event_id || ' ,, ' || event_type AS ids FROM events)
SELECT event_id, array_to_string(list_filter(list_transform(regexp_split_to_array(ids, '[\\n,]+'), lambda x: trim(x)), lambda x: x <> ''), '|') AS doc_ids FROM v""")
def doc_id_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id lists from text with commas and newlines."""
    c = lambda n: F.col(n).cast("string")
    ids = F.concat(F.lit(" d"), c("user_id"), F.lit(",\n d"), c("event_id"), F.lit(" ,, "), c("event_type"))
    return load(spark, sf_dir, "events").select("event_id", F.array_join(T.doc_id_list(ids), "|").alias("doc_ids"))


@query("""
WITH v AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value / 50 - 0.5 END AS v FROM events)
SELECT event_id, round(least(1.0, greatest(0.0, coalesce(v, 0.0))), 6) AS metric FROM v""")
def metric_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics cut to [0, 1], null as 0."""
    v = F.when(F.col("event_id") % 7 != 0, F.col("value") / 50 - 0.5)
    return load(spark, sf_dir, "events").select("event_id", F.round(T.clamp_metric(v), 6).alias("metric"))


_HAS = lambda words: " OR ".join(f"contains(q, '{w}')" for w in words)


@query(f"""
WITH n AS (SELECT conv_id, turn, lower(coalesce(text,'')) AS q FROM conversations),
k AS (SELECT *, least(len(list_filter(regexp_split_to_array(trim(q), '\\s+'), lambda w: w <> '')), 10) AS entity_count,
  CASE WHEN {_HAS(T.AGGREGATION)} THEN 'aggregation' WHEN {_HAS(T.MULTI_HOP)} THEN 'multi_hop' ELSE 'single_hop' END AS complexity,
  ({_HAS(T.TEMPORAL)}) AS temporal FROM n)
SELECT conv_id, turn, complexity, temporal, entity_count::BIGINT AS entity_count,
  CASE WHEN complexity = 'single_hop' AND entity_count <= 2 THEN 'local' WHEN complexity = 'multi_hop' OR entity_count > 5 THEN 'tog'
       WHEN complexity = 'aggregation' THEN 'global' ELSE 'hybrid' END AS mode FROM k""")
def route_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions routed to a retrieval mode."""
    r = load(spark, sf_dir, "conversations").select("conv_id", "turn", T.route(F.col("text")).alias("r"))
    return r.select("conv_id", "turn", "r.complexity", "r.temporal", F.col("r.entity_count").cast("long").alias("entity_count"), "r.mode")


@query("""
WITH v AS (SELECT event_id, 'Server ' || event_type || '_v2 "user ' || user_id || '" CVE-2024-' || (1000 + event_id % 9000) || ' 10.2 ' || event_type AS t FROM events),
e AS (SELECT event_id, list_concat(list_concat(regexp_extract_all(t, '\\bCVE-\\d{4}-\\d{4,7}\\b'), regexp_extract_all(t, '"(.+?)"', 1)),
  list_filter(regexp_extract_all(t, '\\b[A-Za-z0-9][A-Za-z0-9._-]{2,}\\b'), lambda w: NOT regexp_full_match(w, '\\d+(\\.\\d+)*'))) AS l FROM v)
SELECT event_id, (SELECT string_agg(x, '|' ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(l) AS x, generate_subscripts(l, 1) AS i) GROUP BY x)) AS entities FROM e""")
def rule_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by rules alone."""
    c = lambda n: F.col(n).cast("string")
    t = F.concat(F.lit("Server "), c("event_type"), F.lit('_v2 "user '), c("user_id"), F.lit('" CVE-2024-'), (1000 + F.col("event_id") % 9000).cast("string"), F.lit(" 10.2 "), c("event_type"))
    return load(spark, sf_dir, "events").select("event_id", F.array_join(T.rule_entities(t), "|").alias("entities"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a JSON column."""
    return load(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


_ANSWER = "'Answer ' || event_id || chr(10) || '### References' || chr(10) || '- [1] d' || user_id || chr(10) || CASE WHEN event_id % 3 = 0 THEN '- [3] d9' ELSE '- [2] d' || event_id END || CASE WHEN event_id % 2 = 0 THEN chr(10) || '## End' || chr(10) || '- [9] no' ELSE '' END"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda n: F.col(n).cast("string")
    second = F.when(F.col("event_id") % 3 == 0, F.lit("- [3] d9")).otherwise(F.concat(F.lit("- [2] d"), c("event_id")))
    end = F.when(F.col("event_id") % 2 == 0, F.lit("\n## End\n- [9] no")).otherwise(F.lit(""))
    answer = F.concat(F.lit("Answer "), c("event_id"), F.lit("\n### References\n- [1] d"), c("user_id"), F.lit("\n"), second, end)
    ids = F.concat(F.lit("d"), c("user_id"), F.when(F.col("event_id") % 5 > 0, F.concat(F.lit(","), c("event_id"))).otherwise(F.lit("")))
    return load(spark, sf_dir, "events").select("event_id", answer.alias("answer"), ids.alias("ids"))


@query(f"""
WITH a AS (SELECT event_id, {_ANSWER} AS t FROM events),
b AS (SELECT event_id, split_part(split_part(t, '### References' || chr(10), 2), chr(10) || '## ', 1) AS block FROM a)
SELECT event_id, array_to_string(regexp_extract_all(block, '\\[(\\d+)\\]', 1), ',') AS numbers,
  array_to_string(list_transform(regexp_extract_all(block, '\\[\\d+\\] ([^\\n]+)', 1), lambda x: trim(x)), ',') AS titles FROM b""")
def reference_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of an answer's reference block."""
    e = T.reference_entries(T.references_block(F.col("answer")))
    join = lambda f: F.array_join(F.transform(e, lambda x: x[f].cast("string")), ",")
    return _answers(spark, sf_dir).select("event_id", join("n").alias("numbers"), join("title").alias("titles"))


@query("SELECT p_partkey, length(trim(p_name)) < 2 OR regexp_matches(p_name, '\\d{3,}') OR regexp_matches(p_name, '[_-]\\d+$') AS over_specific, regexp_replace(trim(p_name || ' / ' || p_brand), '[^A-Za-z0-9._-]+', '_', 'g') AS slug FROM part")
def type_name_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names too special for a type, and safe slugs."""
    part = load(spark, sf_dir, "part")
    slug = T.safe_slug(F.concat("p_name", F.lit(" / "), "p_brand"))
    return part.select("p_partkey", T.over_specific(F.col("p_name")).alias("over_specific"), slug.alias("slug"))


@query("""
WITH v AS (SELECT event_id, 'chunk-' || user_id || '<SEP> chunk-' || event_id || ' <SEP>other-' || event_id AS s FROM events)
SELECT event_id, array_to_string(list_filter(list_transform(string_split(s, '<SEP>'), lambda x: trim(x)), lambda x: x LIKE 'chunk-%'), '|') AS chunks, string_split(s, '<SEP>')[1] AS first FROM v""")
def sep_list_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk ids of <SEP> lists."""
    c = lambda n: F.col(n).cast("string")
    s = F.concat(F.lit("chunk-"), c("user_id"), F.lit("<SEP> chunk-"), c("event_id"), F.lit(" <SEP>other-"), c("event_id"))
    return load(spark, sf_dir, "events").select("event_id", F.array_join(T.chunk_ids(s), "|").alias("chunks"), T.first_segment(s).alias("first"))


@query("""
SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9_]+'))::BIGINT AS n_tokens,
  md5(CASE WHEN len(regexp_extract_all(text, '[A-Za-z0-9_]+')) <= 50 THEN text ELSE regexp_extract(text, '^(?:[^A-Za-z0-9_]*[A-Za-z0-9_]+){50}') END) AS head_md5 FROM documents""")
def token_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut behind their 50th token."""
    return load(spark, sf_dir, "documents").select("doc_id", T.n_tokens(F.col("text")).cast("long").alias("n_tokens"), F.md5(T.truncate_tokens(F.col("text"), 50)).alias("head_md5"))


@query("""
WITH v AS (SELECT event_id, (['vector_hybrid','lightrag_local','self_query_x','pg[ensemble]','autoschema_v','dynamic_kg','other'])[(event_id % 7)::INT + 1] AS name,
  (['gpt-4','gpt-3.5-turbo','local'])[(event_id % 3)::INT + 1] AS model, user_id * 10 AS tokens FROM events)
SELECT event_id, name, CASE WHEN name LIKE 'vector@_%' ESCAPE '@' THEN 'vector_rag' WHEN contains(name,'self_query') OR contains(name,'parent_child') THEN 'advanced_vector_rag'
  WHEN name LIKE 'lightrag@_%' ESCAPE '@' THEN 'lightrag' WHEN starts_with(name,'pg[') THEN 'property_graph' WHEN contains(name,'autoschema') THEN 'autoschema'
  WHEN contains(name,'dynamic') THEN 'dynamic' ELSE 'unknown' END AS family,
  round(tokens / 1000 * CASE model WHEN 'gpt-4' THEN 0.03 WHEN 'gpt-3.5-turbo' THEN 0.002 ELSE 0.03 END, 6) AS cost FROM v""")
def method_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipeline families and token costs."""
    pick = lambda n, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("event_id") % n + 1).cast("int"))
    name = pick(7, "vector_hybrid", "lightrag_local", "self_query_x", "pg[ensemble]", "autoschema_v", "dynamic_kg", "other")
    model = pick(3, "gpt-4", "gpt-3.5-turbo", "local")
    rows = load(spark, sf_dir, "events").select("event_id", name.alias("name"), model.alias("model"), (F.col("user_id") * 10).alias("tokens"))
    return rows.select("event_id", "name", T.method_family(F.col("name")).alias("family"), F.round(T.cost(F.col("tokens"), F.col("model"), {"gpt-4": 0.03, "gpt-3.5-turbo": 0.002}), 6).alias("cost"))


@query("""
WITH s AS (SELECT unnest([0, 1, 2]) AS level, unnest([2048, 1024, 512]) AS size),
c AS (SELECT doc_id, text, level, size, unnest(range(0, greatest(1, ceil(length(text) / size::DOUBLE)::INT))) AS chunk FROM documents, s)
SELECT doc_id, level::INT AS level, chunk::INT AS chunk, CASE WHEN level > 0 THEN chunk // 2 END::INT AS parent, md5(substring(text, (chunk * size + 1)::INT, size)) AS text_md5 FROM c""")
def leaf_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hierarchical chunks of all three levels with their parents."""
    chunks = R.hierarchical_chunks(load(spark, sf_dir, "documents"))
    return chunks.select("doc_id", "level", "chunk", "parent", F.md5("text").alias("text_md5"))


@query("""WITH t AS (SELECT list(DISTINCT event_type ORDER BY event_type) AS t, count(DISTINCT event_type) AS k FROM events), c AS (SELECT unnest(range(1 << k)) AS combo, t, k FROM t),
s AS (SELECT combo, list_filter(t, lambda x: combo & (1 << (list_position(t, x) - 1)) > 0) AS s FROM c)
SELECT combo::BIGINT AS combo, len(s)::INT AS n, array_to_string(s, '+') AS names, (SELECT count(*) FROM events WHERE list_contains(s, event_type))::BIGINT AS events FROM s""")
def ablation_powerset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All combinations of event types, with the events that each leaves."""
    by = load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    rows = {r["event_type"]: r["n"] for r in by.orderBy("event_type").collect()}  # the components: a handful
    counts = F.create_map(*[x for k, v in rows.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    held = F.filter(F.split("names", r"\+"), lambda x: x != "")
    total = F.aggregate(held, F.lit(0).cast("long"), lambda s, x: s + F.element_at(counts, x))
    return R.ablations(list(rows), spark).withColumn("events", total)


@query(r"""WITH s AS (SELECT trim(CASE p_partkey % 3 WHEN 0 THEN p_type || CASE WHEN p_partkey % 5 = 0 THEN '_' || p_partkey ELSE '' END WHEN 1 THEN p_brand ELSE 'Server' || p_size END) AS name, p_partkey AS pos FROM part)
SELECT name, min(pos) AS pos FROM s WHERE length(name) >= 2 AND NOT regexp_matches(name, '\d{3,}') AND NOT regexp_matches(name, '[_-]\d+$') AND lower(name) NOT IN ('economy', 'server1') GROUP BY name""")
def type_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that may be types, each at its first place: too special and reserved ones go."""
    k, c = F.col("p_partkey"), F.col("p_partkey").cast("string")
    special = F.when(k % 5 == 0, F.concat(F.lit("_"), c)).otherwise(F.lit(""))
    name = F.when(k % 3 == 0, F.concat("p_type", special)).when(k % 3 == 1, F.col("p_brand")).otherwise(F.concat(F.lit("Server"), F.col("p_size").cast("string")))
    return type_names(load(spark, sf_dir, "part").select(name.alias("name"), k.alias("pos")), ("Economy", "server1"))
