"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; set one of our own only on a local master, where all is one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="quern-checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and continue from there.

    The lineage ends at replicated files, so a lost executor costs no more
    than the tasks it was running, and a table used twice is computed once.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, made longer until no column of `df` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def numbered(df: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, int]:
    """`df` with its 0-based place in a total order, and the number of rows.

    One range shuffle sorts the rows; the sorted rows are checkpointed, so that
    the partition borders stay what they are, and only one count for each
    partition (a number chosen here, not by the data) reaches the driver.
    """
    at = "__at"
    rows = cut(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    )
    part = F.shiftright(at, 33)
    counts = dict(rows.groupBy(part.alias("p")).count().collect())
    begin, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        begin.append(total)
        total += counts.get(p, 0)
    starts = F.array(*[F.lit(b).cast("long") for b in begin or [0]])
    place = F.element_at(starts, (part + 1).cast("int")) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn(name, place).drop(at), total
