"""Question sets from records: what a model is asked about one record or about a customer's, and what its answers become."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How sure a pair is taken to be, by its kind, and how much of an action a customer's context shows.
CONFIDENCE = {"local": 0.95, "global": 0.97}
SUMMARY = 100


def _chance(seed: int, *columns: Column | str) -> Column:
    """An order that looks random and is the same in every run."""
    return F.xxhash64(*columns, F.lit(seed))


def local_contexts(records: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """`count` records (NO, Customer, Description, Action), all if fewer, drawn by a seeded hash: place (from 1), subject, ids, context.

    Missing fields are shown as None. Equal records may both be drawn.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    # The fields' names in a context.
    context = F.concat(F.lit("單號: "), shown("NO"), F.lit("\n客戶: "), shown("Customer"), F.lit("\n描述: "), shown("Description"), F.lit("\n處置: "), shown("Action"))
    rows = records.select(F.col("Customer").cast("string").alias("subject"), F.array(shown("NO")).alias("ids"), context.alias("context"))
    return _placed(rows.withColumn("chance", _chance(seed, "context")), count)


def _placed(rows: DataFrame, count: int) -> DataFrame:
    """The `count` rows of least chance, numbered: `count` is what a model is asked, some thousands at most."""
    drawn = rows.orderBy("chance", "context").limit(count)
    return drawn.withColumn("place", F.row_number().over(Window.orderBy("chance", "context"))).drop("chance")


def global_contexts(records: DataFrame, count: int, least: int = 3, most: int = 20, seed: int = 42) -> DataFrame:
    """For `count` customers of at least `least` records: up to `most` of their records, drawn by a seeded hash: place, subject, ids, context.

    Records without a customer have no part. Ids and lines are in the order
    drawn. A customer's records are cut to `most` before they are shuffled, as
    far as they lie in one task, so that a large customer costs no more.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    short = F.substring(F.coalesce(F.col("Action").cast("string"), F.lit("None")), 1, SUMMARY)
    # The fields' names in a line.
    line = F.concat(F.lit("單號:"), shown("NO"), F.lit(" | 描述:"), shown("Description"), F.lit(" | 處置摘要:"), short, F.lit("\n"))
    rows = records.where(F.coalesce("Customer", F.lit("")) != "").select(F.col("Customer").alias("subject"), shown("NO").alias("no"), line.alias("line"))
    sizes = rows.groupBy("subject").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    asked = sizes.orderBy(_chance(seed, "subject"), "subject").limit(count).select("subject")
    tagged = rows.withColumn("chance", _chance(seed, "no", "line"))
    nth = F.row_number().over(Window.partitionBy("subject").orderBy("chance", "no", "line"))
    kept = tagged.withColumn("nth", nth).where(F.col("nth") <= most).join(asked, "subject")
    listed = kept.groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("nth", "no", "line"))).alias("l"))
    context = F.array_join(F.transform("l", lambda x: x["line"]), "")
    return _placed(listed.select("subject", F.transform("l", lambda x: x["no"]).alias("ids"), context.alias("context"), _chance(seed, "subject").alias("chance")), count)


def parsed(response: Column) -> Column:
    """A model's answer as JSON: as it stands, else with single quotes made double; null if neither is an object."""
    read = lambda c: F.try_parse_json(c)
    found = F.coalesce(read(response), read(F.replace(response, F.lit("'"), F.lit('"'))))
    return F.when(F.schema_of_variant(found).startswith("OBJECT"), found)


def pairs(contexts: DataFrame, responses: DataFrame, kind: str) -> DataFrame:
    """Contexts (place, subject, ids) with their answers (place, response) as pairs: id, question, answer, qa_type, source_doc_ids, confidence.

    Answers that aren't JSON objects are left out. A local pair keeps the
    number of its record. Global ones are numbered through, and take the
    sources that the answer names, if it names any, instead of all that were
    shown. Missing questions and answers are empty.
    """
    if kind not in CONFIDENCE:
        raise ValueError(f"unknown kind {kind!r}; known: {', '.join(CONFIDENCE)}")
    met = contexts.join(responses.select("place", parsed(F.col("response")).alias("v")), "place").where("v is not null")
    part = lambda name: F.coalesce(F.try_variant_get("v", f"$.{name}", "string"), F.lit(""))
    named = F.try_variant_get("v", "$.source_ids", "array<string>")
    sources, number = F.col("ids"), F.col("place")
    if kind == "global":
        sources = F.when(F.size(named) > 0, named).otherwise(F.col("ids"))
        met = met.withColumn("number", F.row_number().over(Window.orderBy("place")))  # no more rows than were asked
        number = F.col("number")
    return met.select(
        F.format_string(f"qa_{kind}_%08d", number).alias("id"), part("question").alias("question"), part("answer").alias("answer"),
        F.lit(kind).alias("qa_type"), sources.alias("source_doc_ids"), F.lit(CONFIDENCE[kind]).alias("confidence"),
    )
