"""Rollups, audits, token statistics and the bookkeeping of schema evolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def token_stats(rows: DataFrame, group: str, tokens: str) -> DataFrame:
    """n, mean, median, min, max, both deviations, sum and quartiles by group."""
    c = F.col(tokens)
    r = lambda x: F.round(x.cast("double"), 6)
    return rows.groupBy(group).agg(
        F.count(c).alias("n"), r(F.avg(c)).alias("mean"), r(F.median(c)).alias("median"), F.min(c).alias("least"), F.max(c).alias("most"),
        r(F.stddev_samp(c)).alias("std_sample"), r(F.stddev_pop(c)).alias("std_population"), F.sum(c).alias("total"),
        r(F.percentile(c, F.lit(0.25))).alias("p25"), r(F.percentile(c, F.lit(0.75))).alias("p75"), F.avg(c).cast("int").alias("baseline"),
    )


def against_baseline(stats: DataFrame, group: str, baseline: str) -> DataFrame:
    """Each group's mean against the mean of the group named `baseline`: difference, utilisation %, within 10 and 20 %."""
    base = stats.where(F.col(group) == baseline).select(F.col("mean").alias("base"))
    joined = stats.crossJoin(F.broadcast(base))  # a single row
    use = F.when(F.col("base") > 0, F.col("mean") / F.col("base") * 100)
    off = F.abs(F.col("mean") - F.col("base"))
    return joined.select(
        group, F.round(F.col("mean") - F.col("base"), 6).alias("difference"), F.round(use, 6).alias("utilisation"),
        (off <= 0.1 * F.col("base")).alias("within_10"), (off <= 0.2 * F.col("base")).alias("within_20"),
    )


def average_rows(rows: DataFrame, kind: str, metrics: list[str]) -> DataFrame:
    """Mean of each metric (nulls skipped) over all rows and over each kind: kind is null for all."""
    grouped = rows.withColumn("kind", F.upper(F.trim(kind))).groupingSets([[], [F.col("kind")]], F.col("kind"))
    return grouped.agg(*[F.round(F.avg(m), 6).alias(m) for m in metrics], F.count("*").alias("n"), F.grouping("kind").cast("int").alias("is_total"))


def scope_summary(rows: DataFrame, scopes: list[str], metrics: list[str], known: list[str] | None = None) -> DataFrame:
    """Total, local and global means, in this order; groups without rows are left out.

    The scope is read from the first column of `scopes` with any recognised
    value; a metric that `rows` lacks averages to 0.
    """
    pick = [F.max(F.when(T.qa_scope(F.col(c).cast("string")) != "", 1)).alias(c) for c in scopes]
    seen = rows.agg(*pick).first()
    column = next((c for c in scopes if seen[c]), scopes[0])
    scoped = rows.withColumn("scope", T.qa_scope(F.col(column).cast("string")))
    tagged = scoped.withColumn("scope", F.explode(F.array(F.lit("total"), F.col("scope")))).where("scope in ('total', 'local', 'global')")
    means = [F.round(F.coalesce(F.avg(m), F.lit(0.0)), 6).alias(m) if m in rows.columns else F.lit(0.0).alias(m) for m in [*metrics, *[k for k in known or [] if k not in metrics]]]
    place = F.when(F.col("scope") == "total", 0).when(F.col("scope") == "local", 1).otherwise(2)
    return tagged.groupBy("scope").agg(F.count("*").alias("n"), *means).withColumn("place", place)


def row_mean(columns: list[Column]) -> Column:
    """Mean of those that are numbers, to 4 places."""
    kept = F.filter(F.array(*[F.nanvl(c, F.lit(None).cast("double")) for c in columns]), lambda x: x.isNotNull())
    total = F.aggregate(kept, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(kept) > 0, F.round(total / F.size(kept), 4))


def citation_audit(rows: DataFrame, key: str, answer: str, ids: str) -> DataFrame:
    """For each answer: whether it has a reference heading, its indices run 1..n, and their count equals the ids'."""
    block = T.references_block(F.col(answer))
    entries = T.reference_entries(F.coalesce(block, F.col(answer)))
    numbers = F.transform(entries, lambda e: e["n"])
    n = F.size(numbers)
    sequential = (n > 0) & (numbers == F.sequence(F.lit(1), F.greatest(n, F.lit(1))))
    return rows.select(
        key, block.isNotNull().alias("has_heading"), n.alias("n_references"), sequential.alias("sequential"),
        (n == F.size(T.doc_id_list(F.col(ids)))).alias("count_match"),
    )


def audit_summary(audit: DataFrame) -> DataFrame:
    share = lambda c: F.round(F.avg(F.col(c).cast("int")), 6).alias(c)
    return audit.agg(F.count("*").alias("n"), share("has_heading"), share("sequential"), share("count_match"))


def frequent(suggestions: DataFrame, batches: int, share: float = 0.3) -> DataFrame:
    """Suggestions (batch, name), once a batch, that at least a share of the batches make: name, n."""
    least = max(1, int(batches * share))
    return suggestions.select("batch", "name").distinct().groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def evolved(anchors: DataFrame, suggestions: DataFrame, batches: int, share: float = 0.3, removed: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Type names after additive evolution: the anchors (name), and what at least a share of the batches suggest: name, is_anchor, n.

    Anchors stay, whether suggested or not; n counts the batches that suggest a
    name (0 for others), and names are compared as they are written. `removed`
    (name) holds what a consolidation takes out, of both kinds. `most` keeps
    the most frequent additions, ties by name.
    """
    own = anchors.select("name").distinct().withColumn("is_anchor", F.lit(True))
    seen = frequent(suggestions, batches, 0.0)
    least = max(1, int(batches * share))
    all_of = seen.join(own, "name", "full").select("name", F.coalesce("is_anchor", F.lit(False)).alias("is_anchor"), F.coalesce("n", F.lit(0)).alias("n")).where(F.col("is_anchor") | (F.col("n") >= least))
    if removed is not None:
        all_of = all_of.join(removed.select("name").distinct(), "name", "left_anti")
    if most is None:
        return all_of
    added = all_of.where("not is_anchor").orderBy(F.desc("n"), "name").limit(most)
    return all_of.where("is_anchor").unionByName(added)


def batches(rows: DataFrame, order: str, n: int, share: float = 0.1) -> DataFrame:
    """Rows with their batch: max(1, int(n * share)) to a batch, in order of `order` (whose places are given by `pos`)."""
    size = max(1, int(n * share))
    return rows.withColumn("batch", F.floor(F.col(order) / size).cast("int"))


def convergence(rounds: DataFrame, group: str, order: str, coverage: str, entities: str, most: int = 20) -> DataFrame:
    """For each round whether to stop, and why: `most` reached, coverage within 0.05 over three rounds, or entities within 2."""
    over = Window.partitionBy(group).orderBy(order)
    three = over.rowsBetween(-2, 0)
    n = F.row_number().over(over)
    spread = lambda c: F.max(c).over(three) - F.min(c).over(three)
    reason = F.when(n >= most, "max_rounds").when((n >= 3) & (spread(coverage) < 0.05), "coverage").when((n >= 3) & (spread(entities) < 2), "entities")
    return rounds.withColumn("reason", reason)


def patience(rounds: DataFrame, group: str, order: str, value: str, most: int = 3) -> DataFrame:
    """Consecutive unchanged rounds up to each row, and whether they reach `most`."""
    over = Window.partitionBy(group).orderBy(order)
    changed = F.when(F.col(value).eqNullSafe(F.lag(value).over(over)) & F.lag(F.lit(1)).over(over).isNotNull(), 0).otherwise(1)
    island = F.sum("__changed").over(over.rowsBetween(Window.unboundedPreceding, 0))
    marked = rounds.withColumn("__changed", changed).withColumn("__island", island)
    same = F.row_number().over(Window.partitionBy(group, "__island").orderBy(order)) - 1
    return marked.withColumn("unchanged", same).withColumn("stop", F.col("unchanged") >= most).drop("__changed", "__island")


def groups_of(rows: DataFrame, group: str, item: str, order: str, least: int = 3, most: int = 20, seed: int = 42) -> DataFrame:
    """Groups of at least `least` rows with up to `most` of them, chosen by a seeded hash, joined in order."""
    sized = rows.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    pick = Window.partitionBy(group).orderBy(F.xxhash64(F.col(order), F.lit(seed)), order)
    kept = rows.join(sized, group).withColumn("nth", F.row_number().over(pick)).where(F.col("nth") <= most)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(item).cast("string").alias("t")))), lambda x: x["t"]), "|")
    return kept.groupBy(group).agg(F.first("n").alias("n"), text.alias("items"))


def schema_scores(entity_types: DataFrame, schema_types: DataFrame, relations: DataFrame, typed: DataFrame) -> DataFrame:
    """Coverage (used types that the schema names), specificity (words in a type's name, at most 3, over 3)
    and coherence (relations whose ends both have a type; 1 without relations), in one row."""
    used = entity_types.select("type").distinct()
    cover = used.join(schema_types.select("type").distinct().withColumn("k", F.lit(1)), "type", "left").agg(F.coalesce(F.avg(F.coalesce("k", F.lit(0))), F.lit(0.0)).alias("coverage"))
    words = used.agg(F.least(F.lit(1.0), F.coalesce(F.avg(F.size(F.split("type", r"[\s_]+"))), F.lit(0.0)) / 3).alias("specificity"))
    known = typed.select("id").distinct().withColumn("k", F.lit(1))
    ends = relations.join(known.withColumnsRenamed({"id": "src", "k": "a"}), "src", "left").join(known.withColumnsRenamed({"id": "dst", "k": "b"}), "dst", "left")
    held = ends.agg(F.coalesce(F.avg(F.coalesce(F.col("a") * F.col("b"), F.lit(0))), F.lit(1.0)).alias("coherence"))
    return cover.crossJoin(words).crossJoin(held)  # three single rows


def benchmark_stats(rows: DataFrame, metrics: list[str], overall: str) -> DataFrame:
    """One row: the mean of each metric (NaN and null skipped), least and largest overall score, and the share of rows that have one."""
    real = lambda c: F.when(~F.isnan(c), F.col(c))
    return rows.agg(
        F.count("*").alias("n"), *[F.round(F.avg(real(c)), 6).alias(c) for c in metrics],
        F.min(real(overall)).alias("least"), F.max(real(overall)).alias("most"), F.round(F.avg(real(overall).isNotNull().cast("int")), 6).alias("success"),
    )
