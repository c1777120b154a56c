"""Queries over token statistics, rollups, windows and generation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as T
from ..operators import reports as P
from ..sources.results import comparison
from ..sources.tables import load
from .registry import query


@query("""WITH t AS (SELECT lang, len(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS c FROM documents)
SELECT lang, count(c) AS n, round(avg(c), 6) AS mean, round(median(c), 6)::DOUBLE AS median, min(c)::INT AS least, max(c)::INT AS most, round(stddev_samp(c), 6) AS std_sample, round(stddev_pop(c), 6) AS std_population,
sum(c)::BIGINT AS total, round(quantile_cont(c, 0.25), 6)::DOUBLE AS p25, round(quantile_cont(c, 0.75), 6)::DOUBLE AS p75, floor(avg(c))::INT AS baseline FROM t GROUP BY lang""")
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token statistics by language."""
    rows = load(spark, sf_dir, "documents").select("lang", T.n_tokens(F.col("text")).alias("tokens"))
    return P.token_stats(rows, "lang", "tokens")


@query("""SELECT CASE WHEN grouping(event_type) = 1 THEN NULL ELSE upper(trim(event_type)) END AS kind, round(avg(value), 6) AS value, count(*) AS n, grouping(event_type)::INT AS is_total
FROM events GROUP BY GROUPING SETS ((), (event_type))""")
def average_rows_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over all rows and over each kind."""
    return P.average_rows(load(spark, sf_dir, "events"), "event_type", ["value"])


@query("""WITH m AS (SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1, 2),
l AS (SELECT *, row_number() OVER w AS k, lag(n) OVER w AS before FROM m WINDOW w AS (PARTITION BY user_id ORDER BY day)),
i AS (SELECT *, sum(CASE WHEN before = n THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS island FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY day) - 1 AS unchanged FROM i)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, n, unchanged::INT AS unchanged, unchanged >= 2 AS stop FROM r""")
def patience_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of unchanged daily counts of each user."""
    days = load(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return P.patience(days, "user_id", "day", "n", 2)


@query("""WITH b AS (SELECT DISTINCT o_custkey % 20 AS batch, o_orderpriority || o_orderstatus AS name FROM orders)
SELECT name, count(*) AS n FROM b GROUP BY name HAVING count(*) >= 6""")
def candidate_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions that at least three tenths of the batches make."""
    rows = load(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("batch"), F.concat("o_orderpriority", "o_orderstatus").alias("name"))
    return P.frequent(rows, 20, 0.3)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant turn beside the user turn right before it."""
    c = load(spark, sf_dir, "conversations")
    over = Window.partitionBy("conv_id").orderBy("turn")
    found = c.withColumn("asked", F.lag("text").over(over)).withColumn("was", F.lag("role").over(over)).where("role = 'assistant' and was = 'user'")
    return found.select(F.concat_ws(":", "conv_id", "turn").alias("key"), F.col("text").alias("answer"), F.col("asked").alias("truth"))


_ANSWERS = """WITH l AS (SELECT conv_id || ':' || turn AS key, text AS answer, role, lag(text) OVER w AS truth, lag(role) OVER w AS was FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT key, answer, truth FROM l WHERE role = 'assistant' AND was = 'user'),
"""
_SCORES = """
SELECT key, round(CASE WHEN nt = 0 AND na = 0 THEN 1.0 WHEN nt = 0 THEN 0 ELSE c::DOUBLE / nt END, 6)::DOUBLE AS recall, round(CASE WHEN nt = 0 AND na = 0 THEN 1.0 WHEN na = 0 THEN 0 ELSE c::DOUBLE / na END, 6)::DOUBLE AS precision,
round(CASE WHEN nt = 0 AND na = 0 THEN 1.0 WHEN c = 0 THEN 0 ELSE 2.0 * c / (na + nt) END, 6)::DOUBLE AS f1 FROM m"""


@query(_ANSWERS + """s AS (SELECT key, list_distinct(regexp_extract_all(coalesce(answer, ''), '(?s).')) AS a, list_distinct(regexp_extract_all(coalesce(truth, ''), '(?s).')) AS t FROM p),
m AS (SELECT key, len(list_intersect(a, t)) AS c, len(a) AS na, len(t) AS nt FROM s)
SELECT key, round(CASE WHEN na > 0 AND nt > 0 THEN 2.0 * c / (na + nt) ELSE 0 END, 6)::DOUBLE AS f1 FROM m""")
def char_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 over character sets."""
    return _pairs(spark, sf_dir).select("key", F.round(M.char_f1(F.col("answer"), F.col("truth")), 6).alias("f1"))


def _overlap(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    words = _pairs(spark, sf_dir).select("key", T.ascii_tokens(F.col("answer")).alias("a"), T.ascii_tokens(F.col("truth")).alias("t"))
    rows = words if n == 1 else words.select("key", M.ngrams(F.col("a"), n).alias("a"), M.ngrams(F.col("t"), n).alias("t"))
    scored = M.multiset_scores(M.overlap_counts(rows, "key", "a", "t"), "key")
    return scored.select("key", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "f1")])


_WORDS = """w AS (SELECT key, regexp_extract_all(lower(answer), '[a-z0-9_]+') AS a, regexp_extract_all(lower(truth), '[a-z0-9_]+') AS t FROM p),
x AS (SELECT key, unnest(a) AS g, 1 AS a, 0 AS t FROM w UNION ALL SELECT key, unnest(t), 0, 1 FROM w),
y AS (SELECT key, g, sum(a) AS a, sum(t) AS t FROM x GROUP BY key, g),
z AS (SELECT key, sum(a) AS na, sum(t) AS nt, sum(least(a, t)) AS c FROM y GROUP BY key),
m AS (SELECT p.key, coalesce(na, 0) AS na, coalesce(nt, 0) AS nt, coalesce(c, 0) AS c FROM p LEFT JOIN z USING (key))"""


@query(_ANSWERS + _WORDS + _SCORES)
def rouge1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram overlap."""
    return _overlap(spark, sf_dir, 1)


@query(_ANSWERS + _WORDS.replace("unnest(a) AS g", "unnest([a[i] || ' ' || a[i + 1] for i in range(1, len(a))]) AS g").replace("unnest(t), 0", "unnest([t[i] || ' ' || t[i + 1] for i in range(1, len(t))]), 0") + _SCORES)
def rouge2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigram overlap."""
    return _overlap(spark, sf_dir, 2)


@query()
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest common subsequence of words."""
    rows = _pairs(spark, sf_dir)
    return rows.select("key", F.round(M.rouge_l(T.ascii_tokens(F.col("answer")), T.ascii_tokens(F.col("truth"))), 6).alias("rouge_l"))


@query("""SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def events_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type: the batch twin of the stream."""
    from ..streaming.events import hourly

    return hourly(load(spark, sf_dir, "events"))


_LANG = "t AS (SELECT lang, len(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS c FROM documents), m AS (SELECT lang, avg(c) AS mean FROM t GROUP BY lang)"


def _lang_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.token_stats(load(spark, sf_dir, "documents").select("lang", T.n_tokens(F.col("text")).alias("tokens")), "lang", "tokens")


@query("WITH " + _LANG + """, k AS (SELECT unnest(['local', 'global', 'hybrid', 'mix', 'naive', 'other']) AS mode),
b AS (SELECT lang, mode, floor(mean)::BIGINT AS base, floor(floor(mean) * 1.1::DOUBLE)::BIGINT AS target FROM m, k),
e AS (SELECT *, floor(target * CASE WHEN mode IN ('local', 'global') THEN 0.35::DOUBLE WHEN mode = 'hybrid' THEN 0.25::DOUBLE WHEN mode = 'other' THEN 0 ELSE 0.15::DOUBLE END)::BIGINT AS max_entity_tokens,
  floor(target * CASE WHEN mode IN ('local', 'global') THEN 0.45::DOUBLE WHEN mode = 'hybrid' THEN 0.35::DOUBLE WHEN mode = 'other' THEN 0 ELSE 0.25::DOUBLE END)::BIGINT AS max_relation_tokens FROM b)
SELECT lang, mode, base, target, max_entity_tokens, max_relation_tokens, greatest(1, least(20, (target - max_entity_tokens - max_relation_tokens) // 200)) AS chunk_top_k, greatest(1, target // 500) AS vector_top_k FROM e""")
def token_budget_alloc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token budget for each language and retrieval mode."""
    modes = F.explode(F.array(*[F.lit(m) for m in (*M.SHARES, "other")])).alias("mode")
    rows = _lang_stats(spark, sf_dir).select("lang", "mean", modes).select("lang", "mode", M.token_budget(F.col("mean"), F.col("mode")).alias("b"))
    return rows.select("lang", "mode", *[F.col(f"b.{c}").cast("long").alias(c) for c in ("base", "target", "max_entity_tokens", "max_relation_tokens", "chunk_top_k", "vector_top_k")])


@query("WITH " + _LANG + """, b AS (SELECT round(mean, 6) AS base FROM m WHERE lang = 'en'), r AS (SELECT lang, round(mean, 6) AS mean FROM m)
SELECT lang, round(mean - base, 6) AS difference, round(mean / base * 100, 6) AS utilisation, abs(mean - base) <= 0.1::DOUBLE * base AS within_10, abs(mean - base) <= 0.2::DOUBLE * base AS within_20 FROM r, b""")
def budget_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's mean tokens against English ones."""
    return P.against_baseline(_lang_stats(spark, sf_dir), "lang", "en")


@query("""WITH m AS (SELECT event_type AS method, count(*) AS n, round(avg(user_id), 6) AS mean_tokens, max(user_id) AS most_tokens FROM events GROUP BY event_type)
SELECT method, n, mean_tokens, most_tokens, round(mean_tokens / (SELECT mean_tokens FROM m WHERE method = 'click') * 100, 6) AS utilisation, row_number() OVER (ORDER BY mean_tokens DESC, method) AS place FROM m""")
def method_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods by their mean tokens, against one of them."""
    return comparison(load(spark, sf_dir, "events"), "event_type", "user_id", "click")


@query("""WITH d AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT event_type) / 5.0::DOUBLE AS coverage FROM events GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS nth, max(coverage) OVER t - min(coverage) OVER t AS sc, max(n) OVER t - min(n) OVER t AS se FROM d WINDOW t AS (PARTITION BY user_id ORDER BY day ROWS 2 PRECEDING))
SELECT user_id, day, n, coverage, CASE WHEN nth >= 20 THEN 'max_rounds' WHEN nth >= 3 AND sc < 0.05 THEN 'coverage' WHEN nth >= 3 AND se < 2 THEN 'entities' END AS reason FROM w""")
def convergence_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of a user as rounds: whether to stop, by what the last three had in common."""
    days = load(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), (F.countDistinct("event_type") / 5.0).alias("coverage"))
    return P.convergence(days, "user_id", "day", "coverage", "n")


@query("""SELECT o_custkey, count(*) AS n, string_agg(o_orderkey::VARCHAR, '|' ORDER BY o_orderkey) AS items FROM orders GROUP BY o_custkey HAVING count(*) >= 3""")
def customer_groups3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of three or more orders, with all of them."""
    return P.groups_of(load(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderkey", 3, 1 << 30)


_MARKED = "'Answer ' || event_id || chr(10) || '### References' || chr(10) || '- [1] d' || user_id || chr(10) || CASE WHEN event_id % 3 = 0 THEN '- [3] d9' ELSE '- [2] d' || event_id END || CASE WHEN event_id % 2 = 0 THEN chr(10) || '## End' || chr(10) || '- [9] no' ELSE '' END"
_AUDIT = f"""WITH a AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN props ELSE {_MARKED} END AS t, CASE WHEN event_id % 5 > 0 THEN 2 ELSE 1 END AS ids FROM events),
b AS (SELECT event_id, ids, contains(t, '### References') AS has_heading, CASE WHEN contains(t, '### References') THEN split_part(split_part(t, '### References' || chr(10), 2), chr(10) || '## ', 1) ELSE t END AS block FROM a),
n AS (SELECT event_id, ids, has_heading, regexp_extract_all(block, '\\[(\\d+)\\] \\S', 1) AS ns FROM b),
r AS (SELECT event_id, has_heading, len(ns)::INT AS n_references, len(ns) > 0 AND ns = list_transform(range(1, len(ns) + 1), lambda x: x::VARCHAR) AS sequential, len(ns) = ids AS count_match FROM n)"""


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .texts import _answers

    rows = _answers(spark, sf_dir).join(load(spark, sf_dir, "events").select("event_id", "props"), "event_id")
    return P.citation_audit(rows.withColumn("answer", F.when(F.col("event_id") % 7 == 0, F.col("props")).otherwise(F.col("answer"))), "event_id", "answer", "ids")


@query(_AUDIT + " SELECT * FROM r")
def citation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference lists of answers: there, numbered in order, as many as the ids."""
    return _audit(spark, sf_dir)


@query(_AUDIT + " SELECT count(*) AS n, round(avg(has_heading::INT), 6) AS has_heading, round(avg(sequential::INT), 6) AS sequential, round(avg(count_match::INT), 6) AS count_match FROM r")
def citation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.audit_summary(_audit(spark, sf_dir))


@query(_ANSWERS + r"""w AS (SELECT key, list_filter(regexp_extract_all(lower(answer), '[一-龥]|[^\s\x{4e00}-\x{9fa5}]+'), lambda x: regexp_matches(x, '[a-z0-9一-龥]')) AS a, list_filter(regexp_extract_all(lower(truth), '[一-龥]|[^\s\x{4e00}-\x{9fa5}]+'), lambda x: regexp_matches(x, '[a-z0-9一-龥]')) AS t FROM p),
""" + _WORDS.split("\n", 1)[1] + _SCORES)
def word_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiset F1 of words; each CJK character is a word by itself."""
    words = _pairs(spark, sf_dir).select("key", T.mixed_tokens(F.col("answer")).alias("a"), T.mixed_tokens(F.col("truth")).alias("t"))
    scored = M.multiset_scores(M.overlap_counts(words, "key", "a", "t"), "key")
    return scored.select("key", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "f1")])


_GRAMS = ", ".join(f"""g{n} AS (SELECT key, sum(least(a, t)) AS m FROM (SELECT key, g, sum(a) AS a, sum(t) AS t FROM (
  SELECT key, unnest([array_to_string(a[i:i + {n - 1}], ' ') FOR i IN range(1, len(a) - {n - 2})]) AS g, 1 AS a, 0 AS t FROM w UNION ALL
  SELECT key, unnest([array_to_string(t[i:i + {n - 1}], ' ') FOR i IN range(1, len(t) - {n - 2})]), 0, 1 FROM w) GROUP BY key, g) GROUP BY key)""" for n in (1, 2, 3, 4))


@query(_ANSWERS + _WORDS.split("\n")[0] + _GRAMS + """,
r AS (SELECT w.key, len(a) AS na, len(t) AS nt, coalesce(g1.m, 0) AS m1, coalesce(g2.m, 0) AS m2, coalesce(g3.m, 0) AS m3, coalesce(g4.m, 0) AS m4 FROM w LEFT JOIN g1 ON g1.key = w.key LEFT JOIN g2 ON g2.key = w.key LEFT JOIN g3 ON g3.key = w.key LEFT JOIN g4 ON g4.key = w.key)
SELECT key, round(CASE WHEN na = 0 OR m1 = 0 THEN 0 ELSE (CASE WHEN na >= nt THEN 1 ELSE exp(1 - nt / na::DOUBLE) END) * exp((ln(m1 / na::DOUBLE) + ln((m2 + 1) / (greatest(na - 1, 0) + 1)::DOUBLE) + ln((m3 + 1) / (greatest(na - 2, 0) + 1)::DOUBLE)
  + ln((m4 + 1) / (greatest(na - 3, 0) + 1)::DOUBLE)) / 4) END, 6)::DOUBLE AS bleu FROM r""")
def bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed BLEU of up to four words."""
    words = _pairs(spark, sf_dir).select("key", T.ascii_tokens(F.col("answer")).alias("a"), T.ascii_tokens(F.col("truth")).alias("t"))
    scored = words.select("key", F.size("a").alias("na"), F.size("t").alias("nt"), M.common_grams("a", "t").alias("m"))
    counts = [(F.col("m")[n], F.greatest(F.col("na") - n, F.lit(0))) for n in range(4)]
    return scored.select("key", F.round(M.bleu(counts, F.col("na"), F.col("nt")), 6).alias("bleu"))


@query("""SELECT event_id, round(CASE WHEN event_id % 7 = 0 AND event_id % 11 = 0 THEN NULL WHEN event_id % 7 = 0 THEN value WHEN event_id % 11 = 0 THEN user_id ELSE (value + user_id) / 2.0 END, 4)::DOUBLE AS score FROM events""")
def row_metric_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the metrics that are numbers: NaN and null are left out."""
    a = F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    b = F.when(F.col("event_id") % 7 != 0, F.col("user_id").cast("double"))
    return load(spark, sf_dir, "events").select("event_id", P.row_mean([a, b]).alias("score"))


@query("""WITH f AS (SELECT conv_id, count(*) FILTER (role = 'user') AS nf, count(*) FILTER (role = 'user' AND length(text) % 2 = 0) AS cf, count(*) FILTER (role = 'assistant') AS nc, count(*) FILTER (role = 'assistant' AND length(text) % 3 > 0) AS cc FROM conversations GROUP BY conv_id),
s AS (SELECT conv_id, nf, nc, CASE WHEN nf > 0 THEN cf / nf::DOUBLE END AS r, CASE WHEN nf > 0 THEN CASE WHEN nc > 0 THEN cc / nc::DOUBLE ELSE 0 END END AS p FROM f)
SELECT conv_id, round(r, 6) AS recall, round(p, 6) AS precision, round(CASE WHEN nf > 0 THEN CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END END, 6)::DOUBLE AS f1, nf::INT AS n_facts, CASE WHEN nf > 0 THEN nc::INT END AS n_claims FROM s""")
def key_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts found and claims supported, scored for each conversation."""
    c = load(spark, sf_dir, "conversations")
    n = F.length("text")
    rows = c.groupBy("conv_id").agg(F.collect_list(F.when(F.col("role") == "user", n % 2 == 0)).alias("facts"), F.collect_list(F.when(F.col("role") == "assistant", n % 3 > 0)).alias("claims"))
    s = rows.select("conv_id", M.key_fact_scores(F.col("facts"), F.col("claims")).alias("s"))
    return s.select("conv_id", *[F.round(f"s.{c}", 6).alias(c) for c in ("recall", "precision", "f1")], "s.n_facts", "s.n_claims")
