"""Queries over files that the given tables are written to and read back from, question sets, runs and their summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import as_double, top_by_cosine
from ..operators import hub as H
from ..operators import merge as U
from ..operators import qa as Q
from ..operators import reports as P
from ..operators import retrieve as R
from ..operators import scores as S
from ..operators.lineage import cut, shared_folder
from ..sources import graphs as X
from ..sources import questions as N
from ..sources import records as D
from ..sources import results as E
from ..sources.tables import load
from .graphs import _G
from .merges import _GROUPS, _pairs
from .registry import query
from .reports import _ANSWERS, _WORDS
from .reports import _pairs as _answers


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see; it goes with the checkpoints."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as maintenance records: the status is what is described, the clerk's step what was done."""
    o, c = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").cast("string").alias("NO"), F.col("c_name").alias("Customer"), F.concat(F.lit("E"), (F.col("o_orderkey") % 7).cast("string")).alias("Engineers"),
        day.alias("Service Start"), day.alias("Service End"), F.concat(F.lit("status "), "o_orderstatus", F.lit(" \"held\"")).alias("Description"), F.concat(F.lit("step "), "o_orderpriority").alias("Action"),
    )


_RECORDS = """WITH r AS (SELECT o_orderkey::VARCHAR AS no, c_name AS customer, 'E' || o_orderkey % 7 AS engineer, strftime(o_orderdate, '%Y-%m-%d') AS day, 'status ' || o_orderstatus || ' "held"' AS description, 'step ' || o_orderpriority AS action
FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query(_RECORDS + """ SELECT no AS doc_id, md5('這是一筆關於 ' || customer || ' 的維護紀錄。' || chr(10) || '處理工程師為 ' || engineer || chr(10) || '進行時間為 ' || day || ' 至 ' || day || '。' || chr(10)
  || '狀態描述 (Description): ' || description || chr(10) || '處置動作 (Action): ' || action) AS natural_text,
md5('NO: ' || no || chr(10) || 'Customer: ' || customer || chr(10) || 'Engineers: ' || engineer || chr(10) || 'Start Time: ' || day || chr(10) || 'End Time: ' || day || chr(10) || 'Description: ' || description || chr(10) || 'Action: ' || action) AS key_value_text,
customer, engineer FROM r""")
def records_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as record files, a JSON object a line, and read as documents in two modes."""
    path = _folder(spark, "records")
    _records(spark, sf_dir).write.json(path)
    first, second = D.read_records(spark, path), D.read_records(spark, path, "key_value_text")
    shown = first.select("doc_id", F.md5("text").alias("natural_text"), F.col("metadata")["Customer"].alias("customer"), F.col("metadata")["Engineers"].alias("engineer"))
    return shown.join(second.select("doc_id", F.md5("text").alias("key_value_text")), "doc_id")


@query("SELECT doc_id::VARCHAR AS doc_id, md5(text) AS text_md5, source, lang FROM documents")
def documents_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processed documents written as JSON lines and read back, texts unchanged."""
    path = _folder(spark, "documents")
    meta = T.metadata_map({"source": F.col("source"), "lang": F.col("lang")})
    D.write_documents(load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", meta.alias("metadata")), path)
    back = spark.read.schema("doc_id string, text string, metadata map<string, string>").json(path)
    return back.select("doc_id", F.md5("text").alias("text_md5"), F.col("metadata")["source"].alias("source"), F.col("metadata")["lang"].alias("lang"))


@query(_G + """SELECT 'node' AS part, id AS a, NULL AS b, type AS label, name AS name, NULL::DOUBLE AS weight FROM nodes
UNION ALL SELECT 'edge', src, dst, relation, NULL, weight FROM edges""")
def graphml_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole trade graph written as GraphML and read back."""
    path = _folder(spark, "graphml")
    X.write_graphml(H.trade_graph(spark, sf_dir), path)
    g, none = X.read_graphml(spark, path), F.lit(None)
    nodes = g.nodes.select(F.lit("node").alias("part"), F.col("id").alias("a"), none.cast("string").alias("b"), F.col("type").alias("label"), "name", none.cast("double").alias("weight"))
    return nodes.unionByName(g.edges.select(F.lit("edge").alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("relation").alias("label"), none.cast("string").alias("name"), "weight"))


@query(_GROUPS + """, d AS (SELECT 'V' || u AS node, count(*) AS degree FROM both_ways GROUP BY u), m AS (SELECT 'V' || node AS node, 'V' || component AS component FROM g),
o AS (SELECT m.node, m.component, row_number() OVER (PARTITION BY m.component ORDER BY coalesce(degree, 0) DESC, m.node) AS nth FROM m LEFT JOIN (SELECT node, degree FROM d) d USING (node)),
n AS (SELECT m.node, o.node AS canonical FROM m JOIN o ON o.component = m.component AND nth = 1)
SELECT node, canonical FROM n""")
def merged_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar vectors merged in the graph of their own similarities: each with the name that stays."""
    tag = lambda c: F.concat(F.lit("V"), F.col(c).cast("string"))
    found = cut(_pairs(spark, sf_dir))  # found once, for groups and degrees
    edges = found.select(tag("a").alias("src"), tag("b").alias("dst"), F.lit("like").alias("relation"), F.col("sim").alias("weight"))
    nodes = load(spark, sf_dir, "embeddings").select(tag("vec_id").alias("id"), F.lit("vector").alias("type"), tag("vec_id").alias("name"))
    groups = U.components(edges, "src", "dst")
    return U.merge_groups(H.Graph(nodes, edges), groups)[1]


_TERMS = "t AS (SELECT w AS qid FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS w FROM documents) GROUP BY w ORDER BY count(*) DESC, w LIMIT 10)"


@query("WITH " + _TERMS + """, l AS (SELECT doc_id, text, unnest(range(0, greatest(1, ceil(length(text) / 512.0)::INT))) AS chunk FROM documents),
f AS (SELECT doc_id, chunk // 2 AS parent, count(*) AS leaves FROM l GROUP BY doc_id, parent),
h AS (SELECT qid, doc_id, chunk, chunk // 2 AS parent, count(*)::DOUBLE AS score FROM (SELECT doc_id, chunk, unnest(regexp_extract_all(lower(substring(text, (chunk * 512 + 1)::INT, 512)), '[a-z]+')) AS qid FROM l) JOIN t USING (qid) GROUP BY qid, doc_id, chunk),
p AS (SELECT qid, doc_id, parent, count(*) AS hit, avg(score) AS score FROM h GROUP BY qid, doc_id, parent),
m AS (SELECT p.* FROM p JOIN f USING (doc_id, parent) WHERE hit > 0.5 * leaves)
SELECT qid, doc_id, 1 AS level, parent::INT AS chunk, round(score, 6)::DOUBLE AS score FROM m
UNION ALL SELECT qid, doc_id, 2, chunk::INT, round(score, 6)::DOUBLE FROM h WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.qid = h.qid AND m.doc_id = h.doc_id AND m.parent = h.parent)""")
def auto_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves that hold one of the ten most frequent long words, with parents in place of leaves where most of these were hit."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    asked = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("qid")).groupBy("qid").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "qid").limit(10).select("qid")
    chunks = R.hierarchical_chunks(docs)
    words = chunks.where("level = 2").select("doc_id", "chunk", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("qid"))
    hits = words.join(F.broadcast(asked), "qid").groupBy("qid", "doc_id", "chunk").agg(F.count("*").cast("double").alias("score"))  # ten words
    return R.auto_merge(hits, chunks.drop("text")).withColumn("score", F.round("score", 6))


@query("""WITH h AS (SELECT o_custkey AS qid, 'P' || l_partkey AS src, 'S' || l_suppkey AS dst, row_number() OVER (PARTITION BY o_custkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
e AS (SELECT qid, src AS id, rank, 0 AS side FROM h UNION ALL SELECT qid, dst, rank, 1 FROM h), f AS (SELECT qid, id, min(rank * 2 + side) AS place FROM e GROUP BY qid, id)
SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY place)::INT AS rank FROM f QUALIFY rank <= 10""")
def relation_hit_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten parts and suppliers at the ends of each customer's dearest lines."""
    both = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    tag = lambda t, c: F.concat(F.lit(t), F.col(c).cast("string"))
    place = F.struct(-F.col("l_extendedprice"), "l_orderkey", "l_linenumber")  # an order is enough: no customer's lines are numbered
    return R.endpoints(both.select(F.col("o_custkey").alias("qid"), tag("P", "l_partkey").alias("src"), tag("S", "l_suppkey").alias("dst"), place.alias("rank")), 10)


@query("""WITH n AS (SELECT CASE WHEN p_partkey % 11 = 0 THEN ' ' ELSE 'P' || p_partkey END AS id, CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_name END AS name, CASE WHEN p_size % 7 = 0 THEN '' ELSE p_type END AS type, p_retailprice / 1200 AS confidence, p_partkey FROM part)
SELECT p_partkey, CASE WHEN trim(id) = '' THEN 'empty id' WHEN trim(coalesce(name, '')) = '' THEN 'empty name' WHEN trim(type) = '' THEN 'empty type' ELSE 'confidence out of range' END AS reason
FROM n WHERE trim(id) = '' OR trim(coalesce(name, '')) = '' OR trim(type) = '' OR NOT confidence BETWEEN 0 AND 1""")
def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as nodes, some of which lack what a node needs, with the reason."""
    tag = F.concat(F.lit("P"), F.col("p_partkey").cast("string"))
    nodes = load(spark, sf_dir, "part").select(
        "p_partkey", F.when(F.col("p_partkey") % 11 == 0, " ").otherwise(tag).alias("id"), F.when(F.col("p_size") % 9 != 0, F.col("p_name")).alias("name"),
        F.when(F.col("p_size") % 7 == 0, "").otherwise(F.col("p_type")).alias("type"), (F.col("p_retailprice") / 1200).alias("confidence"),
    )
    return H.violations(nodes).select("p_partkey", "reason")


@query(r"""WITH s AS (SELECT doc_id, unnest(string_split(text, '.')) AS s, unnest(range(len(string_split(text, '.')))) AS pos FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, trim(s, ' ') AS s, min(pos) AS pos FROM s WHERE trim(s, ' ') <> '' GROUP BY doc_id, trim(s, ' '))
SELECT d.doc_id, count(f.s) AS n, md5(coalesce(string_agg(f.s, '|' ORDER BY f.pos), '')) AS contexts FROM documents d LEFT JOIN f USING (doc_id) WHERE d.text IS NOT NULL GROUP BY d.doc_id""")
def cleaned_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of each document as contexts: trimmed, blanks left out, repeated ones once."""
    found = T.clean_contexts(F.split("text", r"\."))
    return load(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(found).cast("long").alias("n"), F.md5(F.array_join(found, "|")).alias("contexts"))


@query(r"""SELECT lang, count(*) AS n, sum(len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+')))::BIGINT AS words, sum(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+')))::BIGINT AS ascii_words FROM documents GROUP BY lang""")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each language's documents in any script, and those of ASCII alone."""
    text = F.coalesce("text", F.lit(""))
    rows = load(spark, sf_dir, "documents").select("lang", F.size(T.unicode_tokens(text)).alias("w"), T.n_tokens(text).alias("a"))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum("w").alias("words"), F.sum("a").alias("ascii_words"))



def _replies(contexts: DataFrame) -> DataFrame:
    """What a model might answer: JSON, JSON in single quotes, no JSON at all; every third names its first source alone."""
    first = F.element_at("ids", 1)
    plain = F.to_json(F.struct(F.concat(F.lit("why "), first).alias("question"), F.concat(F.lit("as "), F.size("ids").cast("string")).alias("answer"), F.when(F.col("place") % 3 == 0, F.array(first)).alias("source_ids")))
    reply = F.when(F.col("place") % 4 == 0, F.lit("no idea")).when(F.col("place") % 4 == 1, F.replace(plain, F.lit('"'), F.lit("'"))).otherwise(plain)
    return contexts.select("place", reply.alias("response"))


@query(_RECORDS + """ SELECT customer AS subject, count(*) AS n, least(count(*), 20) AS shown, sum(length('單號:' || no || ' | 描述:' || description || ' | 處置摘要:' || action || chr(10)))::BIGINT AS chars
FROM r GROUP BY customer HAVING count(*) >= 3 AND count(*) <= 20""")
def qa_global_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model is shown of customers of 3 to 20 records, all of them asked."""
    records = _records(spark, sf_dir)
    sizes = records.groupBy(F.col("Customer").alias("subject")).agg(F.count("*").alias("n"))
    asked = Q.global_contexts(records, sizes.where("n >= 3").count())
    shown = asked.join(sizes.where("n <= 20"), "subject")
    return shown.select("subject", "n", F.size("ids").cast("long").alias("shown"), F.length("context").cast("long").alias("chars"))


@query()
def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred questions on single records and a hundred on customers, from replies as a model might give them."""
    records = _records(spark, sf_dir)
    one, many = Q.local_contexts(records, 100), Q.global_contexts(records, 100)
    return Q.pairs(one, _replies(one), "local").unionByName(Q.pairs(many, _replies(many), "global"))


@query(_ANSWERS + _WORDS + """, b AS (SELECT key, unnest([array_to_string(a[i:i + 1], ' ') FOR i IN range(1, len(a))]) AS g, 1 AS a, 0 AS t FROM w UNION ALL SELECT key, unnest([array_to_string(t[i:i + 1], ' ') FOR i IN range(1, len(t))]), 0, 1 FROM w),
c AS (SELECT key, g, sum(a) AS a, sum(t) AS t FROM b GROUP BY key, g), d AS (SELECT key, sum(a) AS na, sum(t) AS nt, sum(least(a, t)) AS c FROM c GROUP BY key),
s AS (SELECT m.key, CASE WHEN split_part(m.key, ':', 1)::BIGINT % 2 = 0 THEN 'LOCAL' ELSE 'GLOBAL' END AS kind, CASE WHEN m.na > 0 AND m.nt > 0 AND m.c > 0 THEN 2.0 * m.c / (m.na + m.nt) ELSE 0 END AS r1, CASE WHEN m.na > 0 AND m.nt > 0 AND coalesce(d.c, 0) > 0 THEN 2.0 * d.c / (d.na + d.nt) ELSE 0 END AS r2 FROM m LEFT JOIN d USING (key)),
g AS (SELECT '平均' AS row, avg(r1) AS r1, avg(r2) AS r2 FROM s UNION ALL SELECT '平均_' || kind, avg(r1), avg(r2) FROM s GROUP BY kind)
SELECT key AS idx, NULL AS row, round(r1, 6)::DOUBLE AS rouge1_zh, round(r2, 6)::DOUBLE AS rouge2_zh FROM s UNION ALL SELECT NULL, row, round(r1, 6)::DOUBLE, round(r2, 6)::DOUBLE FROM g""")
def backfilled_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old results, average rows among them, with their scores computed afterwards."""
    conv = F.substring_index("key", ":", 1).cast("long")
    own = _answers(spark, sf_dir).select(F.col("key").alias("idx"), F.col("answer").alias("generated_answer"), F.col("truth").alias("ground_truth_answer"), F.when(conv % 2 == 0, "local").otherwise("Global").alias("Q_type"))
    filled = S.backfilled(E.detailed(own), T.ascii_tokens)
    return filled.select("idx", "row", *[F.round(c, 6).alias(c) for c in ("rouge1_zh", "rouge2_zh")])


@query("""SELECT event_id, '{"kind":"' || event_type || '","user":"' || user_id || '"}' AS meta, '[' || user_id || ',' || event_id || ']' AS ids, CASE WHEN event_id = 1 THEN 11 END::INT AS schema_types FROM events""")
def result_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps and lists of results as text, and a schema's facts in the first row alone."""
    meta = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("kind"), F.col("event_type"))
    rows = load(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("idx"), meta.alias("meta"), F.array("user_id", "event_id").alias("ids"))
    return E.with_schema_info(E.cells(rows), {"schema_types": 11}).drop("idx")


@query(_G + """, v AS (SELECT 'type' AS kind, type AS name, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'relation', relation, count(*) FROM edges GROUP BY relation)
SELECT kind, name, n, row_number() OVER (PARTITION BY kind ORDER BY n DESC, name)::INT AS place FROM v""")
def graph_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types and relations of the whole trade graph by frequency."""
    return H.vocabulary(H.trade_graph(spark, sf_dir))


@query("""WITH e AS (SELECT event_type AS pipeline_name, CASE user_id % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'global' ELSE '' END AS scope, value FROM events),
u AS (SELECT pipeline_name, 'total' AS summary_scope, value FROM e UNION ALL SELECT pipeline_name, scope, value FROM e WHERE scope <> '')
SELECT pipeline_name, summary_scope, count(*) AS n, round(avg(value), 6) AS avg_value, 0.0::DOUBLE AS avg_missing FROM u GROUP BY ALL""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's summary of each event type as a pipeline, in total and by scope."""
    kind = F.when(F.col("user_id") % 3 == 0, "Local").when(F.col("user_id") % 3 == 1, "global").otherwise("?")
    rows = load(spark, sf_dir, "events").select(F.col("event_type").alias("pipeline_name"), F.col("event_id").alias("idx"), kind.alias("scope"), "value")
    found = S.run_summary(rows, ["value", "missing"])
    return found.withColumn("avg_value", F.round("avg_value", 6))


@query("""WITH b AS (SELECT DISTINCT o_custkey % 20 AS batch, o_orderpriority || o_orderstatus || o_orderkey % 50 AS name FROM orders), f AS (SELECT name, count(*) AS n FROM b GROUP BY name),
a AS (SELECT DISTINCT 'anchor' || r_regionkey AS name FROM region UNION SELECT DISTINCT o_orderpriority || o_orderstatus || '7' FROM orders)
SELECT name, a.name IS NOT NULL AS is_anchor, coalesce(n, 0)::BIGINT AS n FROM f FULL JOIN a USING (name) WHERE (a.name IS NOT NULL OR n >= 6) AND NOT contains(name, 'O3')""")
def additive_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types after additive evolution in twenty batches, with what a consolidation takes out."""
    name = F.concat("o_orderpriority", "o_orderstatus", (F.col("o_orderkey") % 50).cast("string"))
    rows = load(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("batch"), name.alias("name"), F.concat("o_orderpriority", "o_orderstatus", F.lit("7")).alias("fixed"))
    anchors = load(spark, sf_dir, "region").select(F.concat(F.lit("anchor"), F.col("r_regionkey").cast("string")).alias("name")).unionByName(rows.select(F.col("fixed").alias("name")))
    return P.evolved(anchors, rows, 20, 0.3, rows.where(F.col("name").contains("O3")).select("name"))


@query("""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label, lead(vec_id) OVER w AS next, lead(embedding::DOUBLE[]) OVER w AS u FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
q AS (SELECT id AS qid, v AS qv FROM e WHERE id % 100 = 0),
l AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_similarity(qv, v), 9) DESC, id) AS rank FROM q, e QUALIFY rank <= 6),
r AS (SELECT id, next, [v[i] + u[i] FOR i IN range(1, len(v) + 1)] AS rv FROM e WHERE next IS NOT NULL),
g AS (SELECT qid, id AS src, next AS dst, row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_similarity(qv, rv), 9) DESC, id) AS rank FROM q, r QUALIFY rank <= 6),
p AS (SELECT qid, src AS id, rank * 2 AS place FROM g UNION ALL SELECT qid, dst, rank * 2 + 1 FROM g),
f AS (SELECT qid, id, min(place) AS place FROM p GROUP BY qid, id), s AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY place) AS rank FROM f QUALIFY rank <= 12),
b AS (SELECT qid, id, rank, 0 AS s FROM l UNION ALL SELECT qid, id, rank, 1 FROM s), o AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY qid, id ORDER BY rank, s) = 1)
SELECT qid, 'V' || id AS name, CASE WHEN s = 0 THEN 'local' ELSE 'global' END AS source, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, s) AS r FROM o) WHERE r <= 12""")
def entity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector's seeds: the nearest vectors as entities, and the ends of the nearest relations, which join a label's vectors in order."""
    v = load(spark, sf_dir, "embeddings").select("vec_id", "label", as_double(F.col("embedding")).alias("v"))
    asked = v.where("vec_id % 100 = 0")
    after = R.running_sums(v.select("label", "vec_id", F.lit(1).alias("one")), "label", "vec_id", "one").select("label", "vec_id", "nth")
    pairs = after.join(after.select("label", F.col("vec_id").alias("next"), (F.col("nth") - 1).alias("nth")), ["label", "nth"])
    ends = pairs.join(v.select("vec_id", F.col("v").alias("a")), "vec_id").join(v.select(F.col("vec_id").alias("next"), F.col("v").alias("b")), "next")
    relations = ends.select("vec_id", "next", F.zip_with("a", "b", lambda x, y: x + y).alias("v"))
    tag = lambda c: F.concat(F.lit("V"), F.col(c).cast("string"))
    near = lambda rows, k: top_by_cosine(asked, rows.select("vec_id", "v"), k, "vec_id", "vec_id", "v")
    local = near(v, 6).select(F.col("query").alias("qid"), tag("item").alias("id"), "rank")
    hits = near(relations, 6).join(relations.select(F.col("vec_id").alias("item"), "next"), "item")
    return R.linked(local, hits.select(F.col("query").alias("qid"), tag("item").alias("src"), tag("next").alias("dst"), "rank"), 12)


@query(_ANSWERS.rstrip().rstrip(",") + """, q AS (SELECT coalesce(truth, '') AS query, coalesce(answer, '') AS answer, split_part(key, ':', 1) AS conv FROM p),
s AS (SELECT *, CASE WHEN conv::BIGINT % 2 = 0 THEN 'local' ELSE 'global' END AS qa_scope FROM q)
SELECT 'csr_csv' AS loader, md5(query) AS query, md5(answer) AS answer, conv AS ids, qa_scope FROM s UNION ALL SELECT 'csr_jsonl', md5(query), md5(answer), conv || '|x', qa_scope FROM s
UNION ALL SELECT 'ragas_metadata_csv', md5(trim(query)), md5(trim(answer)), md5(trim(answer)) || CASE WHEN trim(query) <> trim(answer) THEN '|' || md5(trim(query)) ELSE '' END, qa_scope FROM s WHERE trim(query) <> '' AND trim(answer) <> ''""")
def questions_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and answers of the conversations written as three kinds of question files and read by their loaders."""
    conv, blank = F.substring_index("key", ":", 1), lambda c: F.coalesce(F.col(c), F.lit(""))
    kind = F.when(conv.cast("long") % 2 == 0, "SINGLE-HOP").otherwise("MULTI-HOP")
    rows = _answers(spark, sf_dir).select(blank("truth").alias("q"), blank("answer").alias("a"), conv.alias("conv"), kind.alias("kind"))
    folder, found = _folder(spark, "questions"), None
    csv = {"header": True, "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.select(F.col("q").alias("Q"), F.col("a").alias("GT"), F.col("conv").alias("REF"), F.col("kind").alias("Q_type")).write.options(**csv).csv(f"{folder}/csr_csv")
    rows.select(F.col("q").alias("question"), F.col("a").alias("answer"), F.array("conv", F.lit("x")).alias("source_doc_ids"), F.col("kind").alias("hop_level")).write.json(f"{folder}/csr_jsonl")
    texts = rows.where("trim(q) <> '' and trim(a) <> ''")
    texts.select(F.col("q").alias("user_input"), F.col("a").alias("reference"), F.to_json(F.array("a", "q")).alias("reference_contexts"), F.col("kind").alias("question_type")).write.options(**csv).csv(f"{folder}/ragas_metadata_csv")
    for loader in ("csr_csv", "csr_jsonl", "ragas_metadata_csv"):
        one = N.read(spark, loader, f"{folder}/{loader}")
        one = one.select(F.lit(loader).alias("loader"), F.md5(blank("query")).alias("query"), F.md5(blank("ground_truth_answer")).alias("answer"), F.array_join("ground_truth_doc_ids", "|").alias("ids"), "qa_scope")
        found = one if found is None else found.unionByName(one)
    return found


@query("""WITH l AS (SELECT l_orderkey AS k, strftime(l_shipdate, '%Y-%m-%d') AS day, l_linenumber AS n, l_partkey AS p, l_returnflag AS f FROM lineitem),
d AS (SELECT k, day, string_agg('[08:0' || n || '] part ' || p, chr(10) ORDER BY n) AS nurse, string_agg('ship ' || p || ' ' || f, chr(10) ORDER BY n) AS orders, string_agg('plan ' || n, chr(10) ORDER BY n) AS plan FROM l GROUP BY k, day)
SELECT md5('o' || k || day) AS doc_id, md5('患者病歷號 o' || k || '（' || k % 90 || ' 歲，血型 A+，HBV/HCV/HIV: 0/1/0）' || chr(10) || '透析日期：' || day || chr(10) || '--- 護理紀錄 ---' || chr(10) || nurse || chr(10)
  || '--- 醫囑 ---' || chr(10) || orders || chr(10) || '--- 評估計畫 ---' || chr(10) || plan || chr(10) || '--- 過濾器狀態 ---' || chr(10) || '（無）' || chr(10)) AS text_md5, 'o' || k AS case_number, day FROM d""")
def sessions_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nested clinical records, a JSON object a line, read as one text for each order and day of shipping.

    Lines of one number stay in the order of their table.
    """
    day, c = F.date_format("l_shipdate", "yyyy-MM-dd"), lambda n: F.col(n).cast("string")
    line = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.struct("_metadata.file_path", "_metadata.row_index").alias("at"), F.array(F.concat(day, F.lit(" 08:0"), c("l_linenumber")), F.concat(F.lit("part "), c("l_partkey"))).alias("nurse"),
        F.array(day, F.concat(F.lit("ship "), c("l_partkey")), F.lit(""), c("l_returnflag")).alias("order"), F.array(day, F.concat(F.lit("plan "), c("l_linenumber"))).alias("plan"),
    )
    inorder = lambda name: F.transform("l", lambda x: x[name])
    patients = line.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "at", "nurse", "order", "plan"))).alias("l"))  # an order has a few lines
    path = _folder(spark, "sessions")
    patients.select(
        F.concat(F.lit("o"), c("l_orderkey")).alias("case_number"), (F.col("l_orderkey") % 90).cast("string").alias("age"), F.lit("A").alias("blood_type"), F.lit("+").alias("blood_rh"), F.lit("1").alias("hcv"),
        inorder("nurse").alias("nurse_record"), inorder("order").alias("order"), inorder("plan").alias("a+p"),
    ).write.json(path)
    m = F.col("metadata")
    return D.read_sessions(spark, path).select("doc_id", F.md5("text").alias("text_md5"), m["case_number"].alias("case_number"), m["session_date"].alias("day"))
