"""All generation metrics of answers at once, and result files that are given them afterwards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import alignment as A
from ..functions import metrics as M
from ..functions import text as T
from .lineage import cut
from .retrieve import carried

#: The columns that result files get.
COLUMNS = ("rouge1_zh", "rouge2_zh", "rougeL_zh", "rougeLsum_zh", "bleu_zh", "meteor_zh")
#: The columns that name a question's scope, in this order.
SCOPES = ("qa_scope", "scope", "Q_type")
Tokens = Callable[[Column], Column]


def generation_scores(rows: DataFrame, key: str, answer: str, truth: str, tokens: Tokens = T.mixed_tokens, end: str = r"\n") -> DataFrame:
    """ROUGE-1, -2, -L, -Lsum, BLEU and METEOR of each row (`key` tells rows apart), as `key` and COLUMNS.

    `tokens` splits a text, `end` ends its sentences; missing texts are empty. A
    pair of which a side has no words scores 0 in all of them.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    words = cut(rows.select(key, tokens(text(answer)).alias("a"), tokens(text(truth)).alias("t")))
    out = words.select(key, F.size("a").alias("na"), F.size("t").alias("nt"), M.rouge_l(F.col("a"), F.col("t")).alias("rougeL_zh"), A.meteor(F.col("a"), F.col("t")).alias("meteor_zh"))
    split = lambda c: A.sentences(text(c), tokens, end)
    out = out.join(rows.select(key, A.rouge_lsum(split(answer), split(truth)).alias("rougeLsum_zh")), key)
    for n in (1, 2, 3, 4):
        grams = words if n == 1 else words.select(key, M.ngrams(F.col("a"), n).alias("a"), M.ngrams(F.col("t"), n).alias("t"))
        found = M.overlap_counts(grams, key, "a", "t").withColumnsRenamed({"common": f"m{n}", "n_answer": f"a{n}", "n_truth": f"t{n}"})
        out = out.join(found, key)
    f1 = lambda n: F.when(F.col(f"m{n}") > 0, 2.0 * F.col(f"m{n}") / (F.col(f"a{n}") + F.col(f"t{n}"))).otherwise(0.0)
    counts = [(F.col(f"m{n}"), F.greatest(F.col("na") - (n - 1), F.lit(0))) for n in (1, 2, 3, 4)]
    out = out.withColumns({"rouge1_zh": f1(1), "rouge2_zh": f1(2), "bleu_zh": M.bleu(counts, F.col("na"), F.col("nt"))})
    both = (F.col("na") > 0) & (F.col("nt") > 0)
    return out.select(key, *[F.when(both, F.col(c)).otherwise(0.0).alias(c) for c in COLUMNS])


def lacks(rows: DataFrame) -> bool:
    """Whether a result table has both texts, and lacks one of COLUMNS or holds nothing in the first."""
    if not {"generated_answer", "ground_truth_answer"} <= set(rows.columns):
        return False
    return not set(COLUMNS) <= set(rows.columns) or rows.where(F.col(COLUMNS[0]).isNotNull()).isEmpty()


def backfilled(rows: DataFrame, tokens: Tokens = T.mixed_tokens) -> DataFrame:
    """A result table (idx, generated_answer, ground_truth_answer, ...) with COLUMNS computed, unless it has them.

    Rows whose idx, or whose `row` where there is one, names an average (平均)
    get the mean over all others, or over those of their kind (平均_KIND, by
    Q_type). Rows may repeat; further columns stay as they are.
    """
    if not lacks(rows):
        return rows
    label = F.coalesce(F.col("row"), F.col("idx").cast("string")) if "row" in rows.columns else F.col("idx").cast("string")
    kept = [c for c in rows.columns if c not in COLUMNS]
    tagged = cut(rows.select(*kept, F.when(label.rlike("^平均(_|$)"), label).alias("__mean"), F.monotonically_increasing_id().alias("__row")))
    own = tagged.where("__mean is null")
    scored = cut(own.join(generation_scores(own, "__row", "generated_answer", "ground_truth_answer", tokens), "__row"))
    means = [F.avg(c).alias(c) for c in COLUMNS]
    by = scored.agg(*means).select(F.lit("平均").alias("__mean"), *COLUMNS)
    if "Q_type" in rows.columns:
        kinds = scored.where(F.coalesce(F.trim("Q_type"), F.lit("")) != "").groupBy(F.concat(F.lit("平均_"), F.upper(F.trim("Q_type"))).alias("__mean")).agg(*means)
        by = by.unionByName(kinds)
    filled = tagged.where("__mean is not null").join(F.broadcast(by), "__mean", "left")  # a row for each kind of question
    return scored.unionByName(filled.select(scored.columns)).drop("__mean", "__row")


def scoped(details: DataFrame, scopes: tuple[str, ...] = SCOPES) -> DataFrame:
    """Detailed rows (pipeline_name, idx, ...) without average rows, once as total and once as what they are: scope is total, local, global or empty.

    The scope is read from the first of `scopes` of which a pipeline's rows have a value that is recognised.
    """
    own = details.where(~F.coalesce(F.col("idx").cast("string"), F.lit("")).startswith("平均"))
    if "row" in details.columns:
        own = own.where("row is null")
    known = [c for c in scopes if c in details.columns]
    if not known:
        return own.withColumn("scope", F.lit("total"))
    read = {f"__s{i}": T.qa_scope(F.col(c).cast("string")) for i, c in enumerate(known)}
    tagged = own.withColumns(read)
    usable = tagged.groupBy(F.col("pipeline_name").alias("__p")).agg(F.coalesce(*[F.when(F.max(s) != "", F.lit(i)) for i, s in enumerate(read)], F.lit(0)).alias("__at"))
    met = tagged.join(carried(usable), F.col("pipeline_name").eqNullSafe(F.col("__p")))
    own_scope = F.element_at(F.array(*read), F.col("__at") + 1)
    rest = [c for c in own.columns if c != "scope"]
    return met.select(*rest, F.explode(F.array(F.lit("total"), own_scope)).alias("scope"))


def run_summary(details: DataFrame, metrics: list[str], scopes: tuple[str, ...] = SCOPES) -> DataFrame:
    """A run's summary: pipeline_name, summary_scope (total, local, global; those that have rows), n and the mean of each metric as avg_NAME.

    Metrics that the rows lack are 0. See sources.results.append_summary for runs one after the other.
    """
    means = [(F.coalesce(F.avg(m), F.lit(0.0)) if m in details.columns else F.lit(0.0)).alias(f"avg_{m}") for m in metrics]
    rows = scoped(details, scopes).where("scope <> ''")
    return rows.groupBy("pipeline_name", F.col("scope").alias("summary_scope")).agg(F.count("*").alias("n"), *means)


def refreshed(summary: DataFrame, details: DataFrame, scopes: tuple[str, ...] = SCOPES) -> DataFrame:
    """A summary (pipeline_name, and summary_scope where it has one) with avg_ columns taken anew from its pipelines' detailed rows.

    `details` have pipeline_name, idx and COLUMNS. Summary rows without
    detailed rows of their scope keep what they have.
    """
    fresh = scoped(details, scopes).groupBy(F.col("pipeline_name").alias("__p"), F.col("scope").alias("__scope")).agg(*[F.avg(c).alias(f"__{c}") for c in COLUMNS], F.lit(True).alias("__new"))
    scope = F.lower(F.trim("summary_scope")) if "summary_scope" in summary.columns else F.lit("total")
    met = summary.withColumn("__of", scope).join(fresh, (F.col("pipeline_name") == F.col("__p")) & (F.col("__of") == F.col("__scope")), "left")
    old = lambda c: F.col(f"avg_{c}").cast("double") if f"avg_{c}" in summary.columns else F.lit(None).cast("double")
    rest = [c for c in summary.columns if c not in {f"avg_{x}" for x in COLUMNS}]
    return met.select(*rest, *[F.when(F.col("__new"), F.col(f"__{c}")).otherwise(old(c)).alias(f"avg_{c}") for c in COLUMNS])
