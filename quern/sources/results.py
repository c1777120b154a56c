"""Result files: what a run of questions writes, and how a folder of runs is read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.reports import average_rows

TOKEN_COLUMNS = ("context_tokens", "input_tokens", "output_tokens", "total_tokens")


def detailed(rows: DataFrame, kind: str = "Q_type") -> DataFrame:
    """Result rows without list columns, with the token columns (0 where missing) and average rows over all and by kind.

    Average rows have no idx and are named in `row`: 平均 or 平均_KIND; own rows have null there.
    """
    flat = [f.name for f in rows.schema if not f.dataType.simpleString().startswith(("array", "map"))]
    own = rows.select(*flat, *[F.lit(0).alias(c) for c in TOKEN_COLUMNS if c not in flat]).fillna(0, [c for c in TOKEN_COLUMNS if c in flat])
    numbers = [f.name for f in own.schema if f.dataType.simpleString() in ("double", "float", "int", "bigint") and f.name != "idx"]
    means = average_rows(own, kind, numbers)
    label = F.when(F.col("is_total") == 1, F.lit("平均")).otherwise(F.concat(F.lit("平均_"), "kind"))
    return own.withColumn("row", F.lit(None).cast("string")).unionByName(
        means.where("is_total = 1 or coalesce(kind, '') <> ''").select(label.alias("row"), *[F.col(c).cast("double").alias(c) for c in numbers]), allowMissingColumns=True
    )


def retrieval_content(rows: DataFrame) -> DataFrame:
    """idx, query, answers and what was retrieved, of rows with a numeric idx."""
    kept = [c for c in ("idx", "query", "generated_answer", "ground_truth_answer", "entities", "relations", "chunks") if c in rows.columns]
    return rows.where(F.col("idx").cast("string").rlike(r"^\d+$")).select(*kept)


def write_results(rows: DataFrame, folder: str, method: str) -> None:
    """One folder for each method: detailed CSV and retrieval JSON."""
    detailed(rows).write.mode("overwrite").option("header", True).csv(f"{folder}/{method}/detailed")
    retrieval_content(rows).write.mode("overwrite").json(f"{folder}/{method}/retrieval")


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """The detailed results of all methods, each with its method (the folder's name)."""
    rows = spark.read.option("header", True).option("inferSchema", True).csv(f"{folder}/*/detailed")
    return rows.withColumn("method", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/detailed/[^/]*$", 1))


def append_summary(rows: DataFrame, path: str, run: dict[str, str]) -> None:
    """Summary rows of a run, added to those of earlier runs; columns may differ."""
    tagged = rows.withColumns({k: F.lit(v) for k, v in run.items()})
    tagged.write.mode("append").parquet(path)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def comparison(rows: DataFrame, method: str, tokens: str, baseline: str | None = None) -> DataFrame:
    """One row for each method: n, mean and largest tokens, share of the baseline's mean in %, and its place by mean, the largest first."""
    by = rows.groupBy(F.col(method).alias("method")).agg(F.count("*").alias("n"), F.round(F.avg(tokens), 6).alias("mean_tokens"), F.max(tokens).alias("most_tokens"))
    base = by.where(F.col("method") == (baseline or "")).agg(F.max("mean_tokens").alias("base"))  # a single row
    joined = by.crossJoin(F.broadcast(base))
    place = F.count("*").alias("place")
    # The place by a join of the few methods with those above them.
    other = by.select(F.col("method").alias("m"), F.col("mean_tokens").alias("t"))
    above = by.join(other, (F.col("t") > F.col("mean_tokens")) | ((F.col("t") == F.col("mean_tokens")) & (F.col("m") <= F.col("method")))).groupBy("method").agg(place)
    use = F.round(F.col("mean_tokens") / F.when(F.col("base") > 0, F.col("base")) * 100, 6)
    return joined.join(above, "method").select("method", "n", "mean_tokens", "most_tokens", use.alias("utilisation"), "place")


def read_citations(spark: SparkSession, path: str, answer: str = "generated_answer", ids: str = "retrieved_ids", most: int | None = None) -> DataFrame:
    """Answers of result files (CSV with a header, a byte-order mark or none): file, row_index (from 1 in each file), idx, query, answer, ids.

    Columns that a file lacks are null, missing answers and ids are empty, and
    queries are cut to 200 characters. `most` keeps the first rows of each file.
    A file with quoted line ends is one task's, in order; files are many tasks'.
    """
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns]).withColumn("__file", F.col("_metadata.file_path")) if "﻿" not in "".join(rows.columns) else rows.select(*[F.col(f"`{c}`").alias(c.lstrip("﻿")) for c in rows.columns], F.col("_metadata.file_path").alias("__file"))
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in rows.columns else F.lit("")
    given = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    place = F.row_number().over(Window.partitionBy("__file").orderBy("__at"))
    placed = rows.withColumn("__at", F.monotonically_increasing_id()).withColumn("row_index", place)
    kept = placed if most is None else placed.where(F.col("row_index") <= most)
    return kept.select(
        F.regexp_extract("__file", r"([^/]+)$", 1).alias("file"), "row_index", given("idx").alias("idx"), F.substring(given("query"), 1, 200).alias("query"), text(answer).alias("answer"), text(ids).alias("ids")
    )


def save_chunk_ids(mapping: DataFrame, path: str) -> None:
    """Chunk ids with the records that they come from (chunk_id, no), added to those that are there."""
    rows = mapping.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("no").cast("string").alias("no"))
    rows.withColumn("saved", F.current_timestamp()).write.mode("append").parquet(path)


def original_ids(spark: SparkSession, path: str, chunks: DataFrame) -> DataFrame:
    """The records behind ranked chunks (qid, chunk_id, rank), each once at its first place; unknown chunks are left out: qid, no, rank.

    A chunk that was saved again belongs to what it was saved with last.
    """
    known = spark.read.parquet(path).groupBy("chunk_id").agg(F.max_by("no", "saved").alias("no"))
    first = chunks.join(known, "chunk_id").groupBy("qid", "no").agg(F.min("rank").alias("at"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("at", "no"))).select("qid", "no", "rank")


def cells(rows: DataFrame) -> DataFrame:
    """Rows whose nested columns (maps, lists, structs) are JSON text, map keys in order; what is null stays null."""

    def one(field) -> Column:
        c, kind = F.col(f"`{field.name}`"), field.dataType.simpleString()
        if kind.startswith("map"):
            c = F.when(c.isNotNull(), F.map_from_entries(F.array_sort(F.map_entries(c))))
        return (F.to_json(c) if kind.startswith(("map", "array", "struct")) else c).alias(field.name)

    return rows.select(*[one(f) for f in rows.schema])


def with_schema_info(rows: DataFrame, info: dict[str, object]) -> DataFrame:
    """Result rows with a schema's facts in columns of their own, filled in the row whose idx is 1 and null elsewhere."""
    return rows.withColumns({k: F.when(F.col("idx") == 1, F.lit(v)) for k, v in info.items()})
