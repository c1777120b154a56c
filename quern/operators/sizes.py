"""What is small enough to travel with the tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most bytes of a table that travels with the tasks; more is shuffled.
CARRIED = 32 << 20
#: About the most rows of a large table that one task groups.
ROWS = 1_000_000


def bytes_of(df: DataFrame) -> int:
    """About what the rows of `df` take: their columns as text, and sixteen bytes each."""
    sizes = [F.coalesce(F.octet_length(F.to_json(F.struct(f"`{f.name}`")) if f.dataType.simpleString()[:3] in ("arr", "map", "str") and f.dataType.simpleString() != "string" else F.col(f"`{f.name}`").cast("string")), F.lit(0)) for f in df.schema]
    return df.agg(F.coalesce(F.sum(reduce(lambda x, y: x + y, sizes, F.lit(16 * len(sizes))).cast("long")), F.lit(0))).first()[0]


def carried(df: DataFrame, most: int = CARRIED) -> DataFrame:
    """`df`, broadcast if its rows take at most `most` bytes."""
    return F.broadcast(df) if bytes_of(df) <= most else df


def dealt(df: DataFrame, rows: int, *keys: str, each: int = ROWS) -> DataFrame:
    """`df` of about `rows` rows, dealt by `keys` to tasks of about `each` rows if it is large; a small one stays as it is.

    For keys that hardly repeat: maps of what a task groups then stay that
    large, while plain shuffles are merged to a task for each core.
    """
    parts = -(-rows // each)
    return df.repartition(parts, *keys) if parts > df.sparkSession.sparkContext.defaultParallelism else df
