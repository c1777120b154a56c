"""Filters that a question names: an index of attribute values turns words into predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.metrics import ngrams


def value_index(rows: DataFrame, attributes: list[str]) -> DataFrame:
    """attribute, value, key, words: the distinct values of string attributes, with their words as questions would have them."""
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes])).alias("v")
    words = T.unicode_tokens(F.col("value"))
    return rows.select(each).select("v.*").where("value is not null").distinct().select("attribute", "value", F.array_join(words, " ").alias("key"), F.size(words).alias("words")).where("words > 0")


def plans(questions: DataFrame, index: DataFrame) -> DataFrame:
    """qid, attribute, value: what each question (qid, text) names, by whole words, case ignored.

    A value is named if its words stand in the question side by side. Several
    values of one attribute are alternatives; several attributes must all hold.
    """
    longest = index.agg(F.max("words")).first()[0] or 0
    words = T.unicode_tokens(F.coalesce("text", F.lit("")))
    grams = [ngrams(F.col("w"), n) if n > 1 else F.col("w") for n in range(1, longest + 1)]
    said = questions.select("qid", words.alias("w"))
    said = said.select("qid", F.explode(F.array_distinct(F.concat(*grams) if grams else F.col("w"))).alias("key"))
    return said.join(index.select("attribute", "value", "key"), "key").select("qid", "attribute", "value").distinct()


def predicate(plan: list[tuple[str, str]]) -> Column:
    """One question's plan as a filter of literals, which reaches the scan of the table that it is put on."""
    values: dict[str, list[str]] = {}
    for attribute, value in plan:
        values.setdefault(attribute, []).append(value)
    return reduce(lambda a, b: a & b, [F.col(a).isin(*sorted(v)) for a, v in sorted(values.items())], F.lit(True))


def passing(plan: DataFrame, rows: DataFrame, attributes: list[str]) -> DataFrame:
    """qid, filters, n: each plan as text and how many of `rows` pass it.

    Rows are counted by their attributes first, so that plans meet combinations
    of values and not rows.
    """
    combined = rows.groupBy(*[F.col(a).cast("string").alias(a) for a in attributes]).agg(F.count("*").alias("n"))
    keyed = combined.select(F.xxhash64(*attributes, *[F.col(a).isNull() for a in attributes]).alias("combo"), "n", *attributes)
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).alias("value")) for a in attributes])).alias("v")
    met = plan.join(keyed.select("combo", "n", each).select("combo", "n", "v.*"), ["attribute", "value"])
    held = met.groupBy("qid", "combo", "n").agg(F.count_distinct("attribute").alias("held"))
    shown = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "attribute", "value"))), ";")
    need = plan.groupBy("qid").agg(F.count_distinct("attribute").alias("need"), shown.alias("filters"))
    sums = held.join(need.select("qid", "need"), "qid").where("held = need").groupBy("qid").agg(F.sum("n").alias("n"))
    return need.join(sums, "qid", "left").select("qid", "filters", F.coalesce("n", F.lit(0)).alias("n"))
