"""How five filters interact: contractions of a contingency tensor for each part of a corpus.

Each document fails or passes each of five filters. What it fails is summed up
to 32 counts for each part (of all documents, of good and of toxic ones), and
only these counts leave Spark's aggregation. Reshaped to 2x2x2x2x2, a step of
an order of the filters is one contraction: along each axis it selects those
that pass, those that fail, or all. The 600 steps of the 120 orders go through
one `einsum` for each measure.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents

LETTERS = "ABCDE"
FEW_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, SIGNS = 200, 50, 2, "[#$%&*|]"
CELLS, SLICE = 2 ** len(LETTERS), 64
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES)


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, part, h1, h2 (128 bits that stand for the text) and fails, the filters A to D that a text fails.

    `fails` has a bit for each filter, A the highest of five; E, which needs
    other documents, is left at 0. A null text is the empty one, a null source
    the part ''. Only doc_id, text and source are read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("t"))
    words = F.regexp_extract_all("t", F.lit(WORD), F.lit(0))
    rows = rows.select("doc_id", "part", "t", F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("k"))
    chars = F.length("t")
    upper = chars - F.length(F.regexp_replace("t", "[A-Z]", ""))
    fails = (
        F.when(F.col("n") < FEW_WORDS, 16).otherwise(0)
        + F.when(100 * F.col("k").cast("long") < DISTINCT_PERCENT * F.col("n").cast("long"), 8).otherwise(0)
        + F.when(100 * upper.cast("long") > UPPER_PERCENT * chars.cast("long"), 4).otherwise(0)
        + F.when(F.col("t").rlike(SIGNS), 2).otherwise(0)
    )
    return rows.select("doc_id", "part", F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(1), F.col("t")).alias("h2"), fails.alias("fails"))


def contingency(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails, n, good, toxic: the filled cells of each part's tensor.

    Filter E fails a document whose text a smaller doc_id has, whatever part
    that one is of. Repeated rows of the smallest id all pass; a null id is
    neither smaller nor larger than any and passes. A document is good or toxic
    if any label of its id says so; null ids have no labels.

    All shuffles are of narrow rows. Copies of one text are summed up by part
    and label before their smallest id is looked for, so that a text with a
    third of all rows is a few rows.
    """
    rows = judged(docs)
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    known = rows.where("doc_id is not null").join(marks, F.col("doc_id") == F.col("__id"), "left").drop("__id")
    unknown = rows.where("doc_id is null").withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    keys = ["h1", "h2", "part", "fails", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")]
    # The ids of a group are told apart first: the number of rows that have the smallest one is needed.
    each = known.groupBy("doc_id", *keys).agg(F.count("*").alias("n")).unionByName(
        unknown.groupBy("doc_id", *keys).agg(F.count("*").alias("n"))
    )
    # Null ids sort first within least(), so they are kept out of it.
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    group = each.groupBy("h1", "h2", "part", "fails", "good", "toxic").agg(
        F.sum("n").alias("n"), least.alias("least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed")
    )
    first = F.min("least.doc_id").over(Window.partitionBy("h1", "h2"))
    passed = F.col("unnamed") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    parted = group.withColumn("first", first).withColumn("passed", passed).select(
        "part", "good", "toxic", F.explode(F.array(F.struct("fails", F.col("passed").alias("n")), F.struct((F.col("fails") + 1).alias("fails"), (F.col("n") - F.col("passed")).alias("n")))).alias("e")
    )
    counted = parted.where("e.n > 0").select("part", "e.fails", "e.n", (F.col("good") * F.col("e.n")).alias("good"), (F.col("toxic") * F.col("e.n")).alias("toxic"))
    return counted.groupBy("part", "fails").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


ORDERS = ["".join(p) for p in permutations(LETTERS)]
STEPS = [(order, k) for order in ORDERS for k in range(len(LETTERS))]
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)


def _selectors(before: tuple, own: tuple, after: tuple) -> np.ndarray:
    """For each step and axis, what of (pass, fail) a contraction sums up."""
    pick = lambda order, k, at: before if at < k else own if at == k else after
    return np.array([[pick(order, k, order.index(x)) for x in LETTERS] for order, k in STEPS], np.int64)


KEPT, REMOVED, FAILING, ALONE = (_selectors(*x) for x in ((PASS, PASS, ALL), (PASS, FAIL, ALL), (ALL, FAIL, ALL), (PASS, FAIL, PASS)))
OWN = np.array([[int(order[k] == x) for x in LETTERS] for order, k in STEPS], np.int64)


def contracted(tensor: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """(parts, 2, 2, 2, 2, 2, kinds) and (steps, 5, 2) to (parts, steps, kinds)."""
    return np.einsum("pabcdek,sa,sb,sc,sd,se->psk", tensor, *chosen.transpose(1, 0, 2), optimize=True)


def measures(tensor: np.ndarray) -> dict[str, np.ndarray]:
    """Each measure as (parts, steps), from counts (parts, 2, 2, 2, 2, 2, 3) of all, good and toxic documents."""
    kept, removed = contracted(tensor[..., :1], KEPT)[..., 0], contracted(tensor, REMOVED)
    failing, alone = (contracted(tensor[..., :1], x)[..., 0] for x in (FAILING, ALONE))
    gone = removed[..., 0]
    by_filter = np.einsum("ps,sf->pf", gone, OWN)
    shapley = np.einsum("pf,sf->ps", by_filter, OWN)
    return dict(zip(MEASURES, (kept, gone, failing - gone, alone, removed[..., 1], removed[..., 2], shapley)))


def audit(cells: DataFrame) -> DataFrame:
    """A row for each part, order and step, from the cells of contingency(); no part, no row.

    A part's cells are at most 32 rows, whatever it holds; tasks take parts in
    slices, so that memory is fixed.
    """
    listed = cells.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("cells"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, places = [o for o, _ in STEPS], np.array([k + 1 for _, k in STEPS], np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                flat = some.column(1).flatten()
                of = np.repeat(np.arange(some.num_rows), some.column(1).value_lengths().to_numpy())
                tensor = np.zeros((some.num_rows, CELLS, 3), np.int64)
                tensor[of, flat.field("fails").to_numpy()] = np.stack([flat.field(c).to_numpy() for c in ("n", "good", "toxic")], axis=1)
                found = measures(tensor.reshape(-1, *[2] * len(LETTERS), 3))
                columns = [
                    pa.array(np.repeat(some.column(0).to_numpy(zero_copy_only=False), len(STEPS)), pa.string()),
                    pa.array(names * some.num_rows, pa.string()), pa.array(np.tile(places, some.num_rows)),
                    *[pa.array(found[m].ravel()) for m in MEASURES],
                ]
                yield pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", *MEASURES])

    return listed.mapInArrow(each, SCHEMA)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(contingency(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")))


SQL = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [(len(w) < 200)::INT, (100 * len(list_distinct(w)) < 50 * len(w))::INT, (100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t))::INT,
  regexp_matches(t, '[#$%&*|]')::INT, coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)::INT] AS f FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
m AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, f),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a JOIN x b ON b.x <> a.x JOIN x c ON c.x NOT IN (a.x, b.x) JOIN x d ON d.x NOT IN (a.x, b.x, c.x) JOIN x e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (SELECT o, k, substr(o, k, 1) AS letter FROM o, (SELECT unnest(range(1, 6)) AS k)),
y AS (SELECT part, o, k, letter, n, good, toxic, f[strpos('ABCDE', letter)] = 1 AS own, coalesce(list_sum(list_transform(range(1, k), lambda i: f[strpos('ABCDE', substr(o, i, 1))])), 0) > 0 AS gone, list_sum(f) = 1 AS alone FROM m, s),
z AS (SELECT part, o AS filter_order, k::INT AS step, letter, coalesce(sum(n) FILTER (NOT gone AND NOT own), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (own AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (own AND gone), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (own AND alone), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (own AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (own AND NOT gone), 0)::BIGINT AS toxic_lost FROM y GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM z"""
