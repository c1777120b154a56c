"""Queries over the graph of the base tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import as_double, cosine
from ..operators import hub as H
from ..operators import merge as U
from ..operators import pattern as C
from ..operators import retrieve as R
from ..operators import traverse as V
from ..sources.tables import load
from .registry import query

_G = """
WITH nodes AS MATERIALIZED (
  SELECT 'R:' || r_regionkey AS id, 'region' AS type, r_name AS name FROM region
  UNION ALL SELECT 'N:' || n_nationkey, 'nation', n_name FROM nation
  UNION ALL SELECT 'C:' || c_custkey, 'customer', c_name FROM customer
  UNION ALL SELECT 'S:' || s_suppkey, 'supplier', s_name FROM supplier
  UNION ALL SELECT 'P:' || p_partkey, 'part', p_name FROM part
  UNION ALL SELECT 'O:' || o_orderkey, 'order', o_orderkey::VARCHAR FROM orders),
edges AS MATERIALIZED (
  SELECT 'N:' || n_nationkey AS src, 'R:' || n_regionkey AS dst, 'in_region' AS relation, 1.0::DOUBLE AS weight FROM nation
  UNION ALL SELECT 'C:' || c_custkey, 'N:' || c_nationkey, 'in_nation', 1.0 FROM customer
  UNION ALL SELECT 'S:' || s_suppkey, 'N:' || s_nationkey, 'in_nation', 1.0 FROM supplier
  UNION ALL SELECT 'P:' || l_partkey, 'S:' || l_suppkey, 'supplied_by', count(*)::DOUBLE FROM lineitem GROUP BY l_partkey, l_suppkey
  UNION ALL SELECT 'O:' || o_orderkey, 'C:' || o_custkey, 'placed_by', 1.0 FROM orders
  UNION ALL SELECT 'O:' || l_orderkey, 'P:' || l_partkey, 'contains', sum(l_quantity)::DOUBLE FROM lineitem GROUP BY l_orderkey, l_partkey),
near AS MATERIALIZED (SELECT src, dst, max(weight) AS weight FROM (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges) WHERE src <> dst GROUP BY src, dst),
deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id)
"""


def _graph(spark: SparkSession, sf_dir: str) -> H.Graph:
    return H.trade_graph(spark, sf_dir)


def _seeds(spark: SparkSession, sf_dir: str, kinds: str = "CSPO") -> DataFrame:
    """A query for each node whose key is divisible by 100, of the tables with these letters."""
    nodes = _graph(spark, sf_dir).nodes
    key = F.substring_index("id", ":", -1).cast("long")
    return nodes.where(F.substring("id", 1, 1).isin(*kinds) & (key % 100 == 0)).select(F.col("id").alias("qid"), "id", F.lit(1.0).alias("score"))


_SEEDS = "seeds AS (SELECT id AS qid, id, 1.0::DOUBLE AS score FROM nodes WHERE id[1] IN ('C', 'S', 'P', 'O') AND split_part(id, ':', 2)::BIGINT % 100 = 0)"


@query(_G + "SELECT id, type, name FROM nodes")
def kg_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).nodes


@query(_G + "SELECT src, dst, relation, weight FROM edges")
def kg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).edges


@query(_G + "SELECT type, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM nodes), 6) AS share FROM nodes GROUP BY type")
def kg_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by type."""
    return H.statistics(_graph(spark, sf_dir).nodes).withColumn("share", F.round("share", 6))


@query(_G + "SELECT id, degree FROM deg")
def kg_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.degrees(_graph(spark, sf_dir).edges)


@query(_G + """, tri AS (SELECT a.src AS id, count(*) AS t FROM near a JOIN near b ON a.src = b.src AND a.dst < b.dst JOIN near c ON c.src = a.dst AND c.dst = b.dst GROUP BY a.src),
d AS (SELECT src AS id, count(*) AS degree FROM near GROUP BY src)
SELECT id, degree, coalesce(t, 0) AS triangles, round(CASE WHEN degree > 1 THEN 2.0 * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0 END, 6)::DOUBLE AS coefficient
FROM d LEFT JOIN tri USING (id)""")
def kg_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles and clustering coefficient of every node."""
    return H.clustering(_graph(spark, sf_dir).edges).withColumn("coefficient", F.round("coefficient", 6))


#: The least label around each node, ten times over: the trade graph's nodes are at most ten edges apart.
_LABELS = ", c0 AS MATERIALIZED (SELECT src AS node, least(src, min(dst)) AS c FROM near GROUP BY src)" + "".join(
    f", c{k} AS MATERIALIZED (SELECT a.node, least(any_value(a.c), min(b.c)) AS c FROM c{k - 1} a JOIN near ON src = a.node JOIN c{k - 1} b ON b.node = dst GROUP BY a.node)" for k in range(1, 10)
)


@query(_G + _LABELS + " SELECT node, c AS component FROM c9")
def kg_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components, named by their smallest node."""
    return U.components(_graph(spark, sf_dir).edges, "src", "dst")


@query(_G + _LABELS + """, nd AS (SELECT src AS id, count(*) AS degree FROM near GROUP BY src),
tri AS (SELECT a.src AS id, count(*) AS t FROM near a JOIN near b ON a.src = b.src AND a.dst < b.dst JOIN near c ON c.src = a.dst AND c.dst = b.dst GROUP BY a.src),
co AS (SELECT sum(CASE WHEN degree > 1 THEN 2.0 * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0 END) AS clustered FROM nd LEFT JOIN tri USING (id)),
sizes AS (SELECT count(*) AS joined, coalesce(max(size), 0) AS largest FROM (SELECT count(*) AS size FROM c9 GROUP BY c)),
d AS (SELECT count(*) AS nodes, avg(coalesce(degree, 0)) AS avg_degree, max(coalesce(degree, 0)) AS max_degree, count(*) FILTER (degree IS NULL) AS orphans FROM nodes LEFT JOIN deg USING (id))
SELECT nodes, (SELECT count(*) FROM edges) AS edges, round((SELECT count(*) FROM edges) / (nodes * (nodes - 1) / 2.0), 6)::DOUBLE AS density, round(avg_degree, 4)::DOUBLE AS avg_degree, max_degree,
  joined + orphans AS components, round(largest::DOUBLE / nodes, 4)::DOUBLE AS largest_ratio, orphans, round(orphans::DOUBLE / nodes, 4)::DOUBLE AS orphan_ratio, round(clustered::DOUBLE / nodes, 4)::DOUBLE AS avg_clustering FROM d, sizes, co""")
def kg_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, density, components, orphans and clustering of the whole trade graph, orders included, in one row."""
    g = _graph(spark, sf_dir)
    return H.quality(g, U.components(g.edges, "src", "dst"))


def _broken(spark: SparkSession, sf_dir: str) -> H.Graph:
    g = _graph(spark, sf_dir)
    return H.Graph(g.nodes.where("id not in ('N:3', 'S:7')"), g.edges)


_BROKEN = ", kept AS (SELECT * FROM nodes WHERE id NOT IN ('N:3', 'S:7'))"


@query(_G + _BROKEN + """SELECT src, dst, relation, 'head' AS side, src AS missing FROM edges WHERE src NOT IN (SELECT id FROM kept)
UNION ALL SELECT src, dst, relation, 'tail', dst FROM edges WHERE dst NOT IN (SELECT id FROM kept)""")
def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of edges that no node has."""
    return H.dangling(_broken(spark, sf_dir))


@query(_G + _BROKEN + "SELECT src, dst, relation, weight FROM edges WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)")
def valid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.valid_edges(_broken(spark, sf_dir)).select("src", "dst", "relation", "weight")


@query(_G + """, t AS (SELECT e.*, coalesce(a.type, '') AS head_type, coalesce(b.type, '') AS tail_type FROM edges e LEFT JOIN nodes a ON a.id = src LEFT JOIN nodes b ON b.id = dst)
SELECT src, dst, relation, head_type, tail_type, CASE relation WHEN 'in_region' THEN head_type = 'nation' AND tail_type = 'region' WHEN 'in_nation' THEN head_type = 'customer' WHEN 'contains' THEN head_type = 'order' AND tail_type IN ('part', 'supplier') ELSE false END AS valid FROM t""")
def schema_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges against a schema that knows three of the relations."""
    allowed = spark.createDataFrame(
        [("in_region", ["nation"], ["region"]), ("in_nation", ["customer"], []), ("contains", ["order"], ["part", "supplier"])], "relation string, head_types array<string>, tail_types array<string>"
    )
    return H.conformance(_graph(spark, sf_dir), F.broadcast(allowed))


@query(_G + "," + _SEEDS + """, s0 AS (SELECT DISTINCT id FROM seeds), s1 AS (SELECT id FROM s0 UNION SELECT dst FROM near JOIN s0 ON src = id)
SELECT src, dst, relation, weight FROM edges WHERE src IN (SELECT id FROM s1) AND dst IN (SELECT id FROM s1)""")
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges within one hop of the seeds."""
    return H.induced(_graph(spark, sf_dir), _seeds(spark, sf_dir), 1).edges.select("src", "dst", "relation", "weight")


_KHOP = _G + "," + _SEEDS + """, nd AS (SELECT src AS id, count(*) AS degree FROM near GROUP BY src),
h0 AS (SELECT qid, id, 0 AS hop FROM seeds), h1 AS (SELECT DISTINCT qid, dst AS id, 1 AS hop FROM h0 JOIN near ON src = id ANTI JOIN h0 x ON x.qid = h0.qid AND x.id = near.dst),
u1 AS (SELECT * FROM h0 UNION ALL SELECT * FROM h1),
h2 AS (SELECT DISTINCT h1.qid, dst AS id, 2 AS hop FROM h1 JOIN near ON src = id ANTI JOIN u1 x ON x.qid = h1.qid AND x.id = near.dst),
"""


@query(_KHOP + """u2 AS (SELECT * FROM u1 UNION ALL SELECT * FROM h2)
SELECT qid, id, hop::INT AS hop, rank FROM (SELECT qid, id, hop, coalesce(degree, 0) AS rank, row_number() OVER (PARTITION BY qid ORDER BY coalesce(degree, 0) DESC, hop, id) AS place
FROM u2 LEFT JOIN nd USING (id)) WHERE place <= 50""")
def khop_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 50 nodes within two hops of each query's seeds."""
    return V.khop(_graph(spark, sf_dir), _seeds(spark, sf_dir), 2, 50)[0]


@query(_KHOP + """e AS (SELECT qid, least(src, dst) AS a, greatest(src, dst) AS b, 1 AS hop, weight FROM h0 JOIN near ON src = id UNION ALL
SELECT qid, least(src, dst), greatest(src, dst), 2, weight FROM h1 JOIN near ON src = id),
m AS (SELECT qid, a, b, min(hop) AS hop, max(weight) AS weight FROM e GROUP BY qid, a, b)
SELECT qid, a, b, hop::INT AS hop, x.degree + y.degree AS rank, weight FROM m JOIN nd x ON x.id = a JOIN nd y ON y.id = b""")
def khop_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges seen within two hops."""
    return V.khop(_graph(spark, sf_dir), _seeds(spark, sf_dir), 2, 50)[1]


#: Each round as a table of its own: what comes along the edges, and from nodes without edges back to the seed.
_PPR = _G + "," + _SEEDS.replace("'C', 'S', 'P', 'O'", "'C', 'S'") + """, t AS (SELECT src, sum(greatest(weight, 0.01)) AS t FROM near GROUP BY src),
p AS MATERIALIZED (SELECT near.src, dst, greatest(weight, 0.01) / t AS p FROM near JOIN t ON t.src = near.src), v0 AS (SELECT qid, id, 1.0::DOUBLE AS v FROM seeds)""" + "".join(
    f""", v{k} AS MATERIALIZED (SELECT qid, id, sum(v) AS v FROM (SELECT qid, dst AS id, 0.85 * v * p AS v FROM v{k - 1} JOIN p ON src = id UNION ALL SELECT qid, qid, 0.15 FROM seeds
  UNION ALL SELECT qid, qid, 0.85 * v FROM v{k - 1} WHERE id NOT IN (SELECT src FROM t)) GROUP BY qid, id)""" for k in range(1, 7)
)


@query(_PPR + """, r AS (SELECT qid, id, v, row_number() OVER (PARTITION BY qid ORDER BY (qid = id) DESC, round(v, 9) DESC, id) AS place FROM v6)
SELECT qid, id, round(v, 6) AS value, row_number() OVER (PARTITION BY qid ORDER BY round(v, 9) DESC, id)::INT AS rank FROM r WHERE place <= 20""")
def ppr_fixed_iters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six rounds of personalised PageRank around each customer and supplier whose key is divisible by 100: the best 20 and all seeds."""
    g, seeds = _graph(spark, sf_dir), _seeds(spark, sf_dir, "CS")
    values = V.pagerank(g, seeds, rounds=6, tolerance=None)
    return V.pagerank_select(values, seeds, 20).withColumn("value", F.round("value", 6))


@query(_G + ", r AS (SELECT src, relation, dst FROM edges UNION ALL SELECT dst, 'inverse_' || relation, src FROM edges) SELECT concat_ws('|', src, relation, dst) AS triple FROM r")
def inverse_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every relation and its inverse, as triples."""
    edges = _graph(spark, sf_dir).edges
    return H.relation_triples(edges.unionByName(H.inverse(edges))).select("triple")


@query(_G + """, pairs AS (SELECT DISTINCT 'P:' || least(a.p_partkey, b.p_partkey) AS a, 'P:' || greatest(a.p_partkey, b.p_partkey) AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey),
nb AS (SELECT DISTINCT src AS id, dst AS n FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)), sz AS (SELECT id, count(*) AS c FROM nb GROUP BY id),
cm AS (SELECT a, b, count(*) AS c FROM pairs JOIN nb x ON x.id = a JOIN nb y ON y.id = b AND y.n = x.n GROUP BY a, b),
o AS (SELECT a, b, sa.c AS ca, sb.c AS cb, coalesce(cm.c, 0) / (sa.c + sb.c - coalesce(cm.c, 0))::DOUBLE AS overlap FROM pairs LEFT JOIN cm USING (a, b) LEFT JOIN sz sa ON sa.id = a LEFT JOIN sz sb ON sb.id = b)
SELECT a, b, round(coalesce(overlap, 0), 6)::DOUBLE AS overlap FROM o WHERE ca IS NULL OR cb IS NULL OR overlap >= 0.02""")
def topo_gated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one brand and type that share enough neighbours."""
    part = load(spark, sf_dir, "part").where("p_brand is not null and p_type is not null and p_partkey is not null")
    members = part.select(F.concat(F.lit("P:"), F.col("p_partkey").cast("string")).alias("id"), F.struct("p_brand", "p_type").alias("group"), F.col("p_partkey").alias("place"))
    return U.topology_gate_within(members, _graph(spark, sf_dir), 0.02).withColumn("overlap", F.round("overlap", 6))


def _beam_sql(prune: bool) -> str:
    """The beam written out: three rounds of paths, what they tried, and how often the last beam holds it."""
    out = _G + "," + _SEEDS.replace("'C', 'S', 'P', 'O'", "'C', 'S'")
    out += ", steps AS MATERIALIZED (SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS nth FROM near)" + (" WHERE nth <= 3)" if prune else ")")
    out += ", b0 AS MATERIALIZED (SELECT qid, [id] AS path, id AS tail, 0.0::DOUBLE AS total, 10.0::DOUBLE AS score FROM seeds)"
    for k in (1, 2, 3):
        score = f"(score * {k} + 5) / {k + 1}" if prune else f"(total + weight) / {k}"
        out += f", t{k} AS MATERIALIZED (SELECT qid, list_append(path, dst) AS path, dst AS tail, total + weight AS total, {score} AS score FROM b{k - 1} JOIN steps ON src = tail WHERE NOT list_contains(path, dst))"
        out += f", b{k} AS MATERIALIZED (SELECT * FROM t{k} QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, array_to_string(path, '>')) <= 5)"
    tried = " UNION ".join(["SELECT qid, tail AS id FROM b0", *(f"SELECT qid, tail FROM t{k}" for k in (1, 2, 3))])
    out += f", visited AS ({tried}), held AS (SELECT qid, id, count(*) AS n FROM (SELECT qid, unnest(path) AS id FROM b3) GROUP BY qid, id)"
    out += ", marked AS (SELECT qid, id, coalesce(n, 0) + CASE WHEN qid = id THEN 100 ELSE 0 END AS frequency, qid = id AS is_seed, count(*) OVER (PARTITION BY qid) AS whole FROM visited LEFT JOIN held USING (qid, id))"
    return out + " SELECT qid, id, frequency::BIGINT AS frequency, is_seed FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY frequency DESC, id) AS place FROM marked WHERE whole <= 20 OR frequency > 0) WHERE place <= 20"


@query(_beam_sql(False))
def tog_beam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beams of paths from each customer and supplier whose key is divisible by 100, by the mean weight of their edges."""
    return V.beam(_graph(spark, sf_dir), _seeds(spark, sf_dir, "CS").withColumn("rank", F.lit(1)))


@query(_beam_sql(True))
def tog_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, along the three heaviest edges of each tail."""
    return V.beam(_graph(spark, sf_dir), _seeds(spark, sf_dir, "CS").withColumn("rank", F.lit(1)), prune=3)


@query()
def pcst_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of short paths: for each region, what joins the first suppliers whose key is divisible by 10."""
    s = load(spark, sf_dir, "supplier").where("s_suppkey % 10 = 0").join(load(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    seeds = s.select(F.concat(F.lit("Q:"), F.col("n_regionkey").cast("string")).alias("qid"), F.concat(F.lit("S:"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_suppkey").alias("rank"))
    return V.steiner(_graph(spark, sf_dir), seeds, terminals=4)


@query(_G + "," + _SEEDS.replace("'C', 'S', 'P', 'O'", "'C', 'S'") + r""", dg AS (SELECT src AS id, count(*) AS rank FROM near GROUP BY src),
cand AS MATERIALIZED (SELECT DISTINCT qid, dst AS id FROM seeds JOIN near ON src = id WHERE dst <> id),
w AS (SELECT qid, id, regexp_extract_all(lower(type || ' ' || name), '[a-z0-9_]+') AS w FROM cand JOIN nodes USING (id)),
st AS (SELECT qid, count(*) AS n, sum(len(w))::DOUBLE / greatest(count(*), 1) AS avgdl FROM w GROUP BY qid),
tf AS (SELECT qid, id, term, count(*) AS tf FROM (SELECT qid, id, unnest(w) AS term FROM w) WHERE term IN ('nation', 'order', '7', 'germany', 'steel') GROUP BY qid, id, term),
df AS (SELECT qid, term, count(*) AS df FROM tf GROUP BY qid, term),
bm AS (SELECT tf.qid, tf.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / greatest(tf + 1.5 * (0.25 + 0.75 * greatest(len(w), 1) / greatest(avgdl, 1e-9)), 1e-9)) AS s FROM tf JOIN df ON df.qid = tf.qid AND df.term = tf.term JOIN w ON w.qid = tf.qid AND w.id = tf.id JOIN st ON st.qid = tf.qid GROUP BY tf.qid, tf.id),
co AS (SELECT c.qid, c.id, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS c FROM cand c JOIN embeddings x ON x.vec_id = split_part(c.qid, ':', 2)::BIGINT JOIN embeddings y ON y.vec_id = split_part(c.id, ':', 2)::BIGINT),
sc AS (SELECT c.qid, c.id, coalesce(s, 0) AS s, min(coalesce(s, 0)) OVER w AS lo, max(coalesce(s, 0)) OVER w AS hi, coalesce(c, 0) AS c, min(coalesce(c, 0)) OVER w AS cl, max(coalesce(c, 0)) OVER w AS ch
  FROM cand c LEFT JOIN bm ON bm.qid = c.qid AND bm.id = c.id LEFT JOIN co ON co.qid = c.qid AND co.id = c.id WINDOW w AS (PARTITION BY c.qid)),
h1 AS MATERIALIZED (SELECT qid, sc.id, 1 AS hop, 0.5 * CASE WHEN hi > lo THEN (s - lo) / (hi - lo) ELSE 0 END + 0.5 * CASE WHEN ch > cl THEN (c - cl) / (ch - cl) ELSE 0 END AS h, rank FROM sc JOIN dg ON dg.id = sc.id),
fr AS (SELECT qid, id FROM h1 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(h, 9) DESC, rank DESC, id) <= 20),
h2 AS (SELECT DISTINCT fr.qid, dst AS id FROM fr JOIN near ON src = fr.id ANTI JOIN h1 ON h1.qid = fr.qid AND h1.id = near.dst ANTI JOIN seeds ON seeds.qid = fr.qid AND seeds.id = near.dst),
u AS (SELECT * FROM h1 UNION ALL SELECT qid, h2.id, 2, 0, rank FROM h2 JOIN dg ON dg.id = h2.id UNION ALL SELECT qid, seeds.id, 0, 0, coalesce(rank, 0) FROM seeds LEFT JOIN dg ON dg.id = seeds.id)
SELECT qid, id, hop::INT AS hop, round(h, 6)::DOUBLE AS hybrid_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(h, 9) DESC, rank DESC, id) AS place FROM u) WHERE place <= 20""")
def anchor_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of each seed by BM25 for a question and by the cosine of their vectors, then by degree; what lies behind the best of them follows."""
    g, seeds = _graph(spark, sf_dir), _seeds(spark, sf_dir, "CS")
    texts = g.nodes.select("id", F.concat_ws(" ", "type", "name").alias("text"))
    asked = seeds.select("qid", F.lit("nation order 7 GERMANY steel").alias("text"))
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", as_double(F.col("embedding")).alias("v"))
    key = lambda c: F.substring_index(c, ":", -1).cast("long")

    def cosines(cand: DataFrame) -> DataFrame:
        """Of the vectors that have the nodes' keys."""
        keyed = cand.select("qid", "id", key("qid").alias("k"), key("id").alias("vec_id")).join(vectors, "vec_id")
        return keyed.join(vectors.select(F.col("vec_id").alias("k"), F.col("v").alias("w")), "k").select("qid", "id", cosine(F.col("v"), F.col("w")).alias("cos"))

    return V.anchor_hybrid(g, seeds, texts, asked, hops=2, cosines=cosines).withColumn("hybrid_score", F.round("hybrid_score", 6)).select("qid", "id", "hop", "hybrid_score", "rank")


@query(_G + "SELECT count(DISTINCT n.id) AS nodes, (SELECT count(*) FROM edges) AS edges, round((SELECT count(*) FROM edges) / (count(DISTINCT n.id) * (count(DISTINCT n.id) - 1) / 2.0), 6)::DOUBLE AS density, round((SELECT count(*) FROM edges) / (count(DISTINCT n.id) * (count(DISTINCT n.id) - 1.0)), 6)::DOUBLE AS directed FROM nodes n")
def kg_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges over all possible ones."""
    g = _graph(spark, sf_dir)
    n, m = g.nodes.agg(F.countDistinct("id").alias("nodes")), g.edges.agg(F.count("*").alias("edges"))
    both = n.crossJoin(m)  # two single rows
    return both.select("nodes", "edges", H.density(F.col("nodes"), F.col("edges")).alias("density"), H.density(F.col("nodes"), F.col("edges"), True).alias("directed"))


@query(_G + "SELECT id, type, name FROM nodes WHERE id NOT IN (SELECT src FROM edges WHERE weight > 1 UNION SELECT dst FROM edges WHERE weight > 1)")
def isolated_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes without edges in the graph of the edges that stand for more than one row or piece."""
    g = _graph(spark, sf_dir)
    return H.isolated(H.Graph(g.nodes, g.edges.where("weight > 1")))


@query(_G + """, e AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, weight FROM edges), hits AS (SELECT id AS qid, id FROM nodes WHERE id[1] = 'S')
SELECT qid, a, b, max(weight) AS weight FROM hits JOIN e ON id = a OR id = b GROUP BY qid, a, b""")
def hit_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges at each supplier, as a vector search's hits get them."""
    g = _graph(spark, sf_dir)
    hits = g.nodes.where("type = 'supplier'").select(F.col("id").alias("qid"), "id", F.lit(1.0).alias("score"))
    return R.enrich(hits, g.nodes, g.edges)[1]


@query("""SELECT 'n' || n_nationkey AS qid, 'S:' || s_suppkey AS src, 'in_nation' AS relation, 'N:' || n_nationkey AS dst FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT DISTINCT 's' || s_suppkey, 'P:' || l_partkey, 'supplied_by', 'S:' || s_suppkey FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE s_suppkey % 10 = 0
UNION ALL SELECT 'r', 'N:' || n_nationkey, 'in_region', 'R:' || n_regionkey FROM nation
UNION ALL SELECT 'n' || n_nationkey, 'S:' || s_suppkey, 'in_nation', 'N:' || s_nationkey FROM nation, supplier WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)
UNION ALL SELECT DISTINCT 's' || x.s_suppkey, 'P:' || l_partkey, 'supplied_by', 'S:' || l_suppkey FROM supplier x, lineitem WHERE x.s_suppkey % 10 = 0 AND x.s_suppkey NOT IN (SELECT l_suppkey FROM lineitem)""")
def cypher_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph patterns by their names, relations and labels: each nation's suppliers, every tenth supplier's parts, and one by labels alone.

    A nation without suppliers gets what its pattern's labels leave."""
    n, s = load(spark, sf_dir, "nation"), load(spark, sf_dir, "supplier").where("s_suppkey % 10 = 0")
    patterns = n.select(F.concat(F.lit("n"), "n_nationkey").alias("qid"), F.format_string("MATCH (s:supplier)-[r:IN_NATION]->(n:nation {name: '%s'}) RETURN s, r, n", "n_name").alias("pattern")).unionByName(
        s.select(F.concat(F.lit("s"), "s_suppkey").alias("qid"), F.format_string("MATCH (p:Part)-[:supplied_by|nothing]->(s) WHERE s:Supplier AND (s:supplier) AND s.name = '%s' RETURN p", "s_name").alias("pattern"))
    )
    labels = n.limit(1).select(F.lit("r").alias("qid"), F.lit("MATCH (n:Nation)-->(r:Region) RETURN n").alias("pattern"))
    return C.select_each(_graph(spark, sf_dir), patterns.unionByName(labels))


@query(_G + "SELECT relation, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM edges), 6) AS share, round(avg(weight), 6) AS mean_weight FROM edges GROUP BY relation")
def kg_relation_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by relation, with their mean weight."""
    return H.relation_statistics(_graph(spark, sf_dir).edges, "weight").select("relation", "n", F.round("share", 6).alias("share"), F.round("mean", 6).alias("mean_weight"))


@query(_G + "SELECT id, type FROM nodes WHERE type NOT IN ('region', 'nation', 'customer', 'part')")
def entity_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of types that a schema of four doesn't know."""
    known = spark.createDataFrame([("Region",), ("nation",), ("customer",), ("part",)], "type string")
    return H.unknown_types(_graph(spark, sf_dir).nodes, known).select("id", "type")
