"""Question sources: CSV and JSON-lines files as source, query, ground_truth_answer, ground_truth_doc_ids, Q_type, Hop_Level, qa_scope."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Where a question's type and hop level may stand, first one first.
TYPE_COLUMNS = ("Q_type", "question_type", "Question_Type")
HOP_COLUMNS = ("Hop_Level", "hop-level", "hop_level")


def _first(df: DataFrame, names: tuple[str, ...]) -> Column:
    there = [T.present(F.col(f"`{n}`").cast("string")) for n in names if n in df.columns]
    return F.coalesce(*there, F.lit(""))


def _normal(df: DataFrame, query: Column, answer: Column, ids: Column) -> DataFrame:
    kind, hop = _first(df, TYPE_COLUMNS), _first(df, HOP_COLUMNS)
    scope = T.qa_scope(kind)
    return df.select(
        F.col("_metadata.file_name").alias("source"), query.alias("query"), answer.alias("ground_truth_answer"), ids.alias("ground_truth_doc_ids"),
        kind.alias("Q_type"), hop.alias("Hop_Level"), F.when(scope != "", scope).otherwise(T.qa_scope(hop)).alias("qa_scope"),
    )


def _no_ids() -> Column:
    return F.array().cast("array<string>")


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Columns Q, GT and REF; an empty REF gives no ids, any other one id."""
    df = _csv(spark, path)
    ref = T.present(F.col("REF"))
    return _normal(df, F.col("Q"), F.col("GT"), F.when(ref.isNotNull(), F.array(ref)).otherwise(_no_ids()))


def _json(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """The fields of JSON lines, and type and hop columns; blank lines are skipped, broken ones an error."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", fields, {"mode": "FAILFAST"}).alias("r")
    # Some names differ in case alone, which columns can't: take the first that says anything here.
    first = lambda names: F.coalesce(*[T.present(F.get_json_object("value", f"$['{n}']")) for n in names])
    return rows.select(parsed, first(TYPE_COLUMNS).alias("Q_type"), first(HOP_COLUMNS).alias("Hop_Level"), "_metadata").select("r.*", "Q_type", "Hop_Level", "_metadata")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """question, answer and source_doc_ids of JSON lines, with empty defaults."""
    df = _json(spark, path, "question string, answer string, source_doc_ids array<string>")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return _normal(df, blank("question"), blank("answer"), F.coalesce("source_doc_ids", _no_ids()))


def read_long_json(spark: SparkSession, path: str) -> DataFrame:
    """input or question, answer or answers (one a line), source_doc_ids or else the id of the context."""
    df = _json(spark, path, "input string, question string, answer string, answers array<string>, context string, source_doc_ids array<string>")
    full = lambda c: F.when(F.col(c) != "", F.col(c))
    context = F.when(F.coalesce("context", F.lit("")) != "", F.array(T.context_id(F.col("context")))).otherwise(_no_ids())
    ids = F.when(F.size(F.coalesce("source_doc_ids", _no_ids())) > 0, F.col("source_doc_ids")).otherwise(context)
    return _normal(df, F.coalesce(full("input"), full("question"), F.lit("")), T.answer_text(F.col("answer"), F.col("answers")), ids)


def literal_list(text: Column) -> Column:
    """The texts of a list literal ('[...]' with strings in either quotes), trimmed, blanks dropped; other text is one item itself.

    JSON lists and lists in single quotes are read; a list that is neither is kept as one text.
    """
    t = T.present(text)
    as_json = F.from_json(t, "array<string>")
    # 'a', "b" -> the strings between their quotes, with escaped quotes kept in.
    item = r"""'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)\""""
    whole = rf"(?s)^\[\s*(?:(?:{item})\s*(?:,\s*(?:{item})\s*)*,?\s*)?\]$"
    single, double = F.regexp_extract_all(t, F.lit(item), 1), F.regexp_extract_all(t, F.lit(item), 2)
    plain = lambda x: F.regexp_replace(F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t")), r"\\(.)", "$1")
    read = F.transform(F.zip_with(single, double, lambda a, b: F.concat(a, b)), plain)
    items = F.when(as_json.isNotNull(), as_json).when(t.rlike(whole), read).otherwise(F.array(t))
    return F.when(t.isNull(), _no_ids()).otherwise(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != ""))


def read_contexts_csv(spark: SparkSession, path: str) -> DataFrame:
    """user_input, reference and reference_contexts (a list literal), whose texts' ids are the truth, each once."""
    df = _csv(spark, path)
    ids = F.array_distinct(F.transform(literal_list(F.col("reference_contexts")), lambda c: F.md5(F.trim(c))))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    return _normal(df, blank("user_input"), blank("reference"), ids)


#: The names that configurations give the loaders.
LOADERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "csr_csv": read_csv, "csr_jsonl": read_json, "ultradomain_jsonl": read_long_json, "ragas_metadata_csv": read_contexts_csv,
}


def read(spark: SparkSession, loader: str, path: str) -> DataFrame:
    """Questions by the name of their loader."""
    if loader not in LOADERS:
        raise ValueError(f"unknown question loader {loader!r}; known: {', '.join(sorted(LOADERS))}")
    return LOADERS[loader](spark, path)
