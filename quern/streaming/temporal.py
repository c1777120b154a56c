"""Facts that change over time: the newest of each attribute, its history, what was known when; for tables and streams.

A fact is a row (entity, attribute, ts, fact_id, value). Of two facts the one
of later ts is newer, of equal ts the one of larger fact_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.lineage import cut

KEY = ["entity", "attribute"]
FACT = "entity string, attribute string, ts timestamp_ntz, fact_id long, value double"


def newest(facts: DataFrame) -> DataFrame:
    """The newest fact of each entity's attributes: entity, attribute, ts, fact_id, value."""
    best = F.max_by(F.struct("ts", "fact_id", "value"), F.struct("ts", "fact_id"))
    return facts.groupBy(*KEY).agg(best.alias("f")).select(*KEY, "f.*")


def last_known(rows: DataFrame, keys: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """`rows` with `name`: the last non-null `value` of the rows before, by `keys`, in `order` (which tells rows apart).

    Rows are dealt by ranges of keys and order, and what earlier ranges end
    with is carried into later ones, so that a key of any size is spread.
    """
    places = {f"__o{i}": c for i, c in enumerate(order)}
    own = rows.columns
    dealt = cut(rows.withColumns(places).repartitionByRange(*keys, *places).withColumn("__part", F.spark_partition_id()))
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*places)))
    parts = dealt.groupBy(*keys, "__part").agg(last.alias("__last"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    came = parts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), F.last("__last", ignorenulls=True).over(before).alias("__came"))
    within = Window.partitionBy(*keys, "__part").orderBy(*places).rowsBetween(Window.unboundedPreceding, -1)
    known = dealt.withColumn("__own", F.last(value, ignorenulls=True).over(within))
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return known.join(came, same).withColumn(name, F.coalesce("__own", "__came")).select(*own, name)


def timeline(facts: DataFrame) -> DataFrame:
    """The history of each attribute, a row for each change: entity, attribute, value, since, until, current.

    Facts that repeat the value before them change nothing; null values are
    left out. `until` is the next change's time, null for the current value.
    """
    rows = facts.where("value is not null").withColumn("held", F.struct("value"))
    forth = [F.unix_micros(F.col("ts").cast("timestamp")), F.col("fact_id")]
    changed = last_known(rows, KEY, forth, "held", "before").where(~F.col("value").eqNullSafe(F.col("before.value")))
    back = [-c for c in forth]
    ended = last_known(changed.select(*KEY, "ts", "fact_id", "value"), KEY, back, "ts", "until")
    return ended.select(*KEY, "value", F.col("ts").alias("since"), "until", F.col("until").isNull().alias("current"))


def as_of(facts: DataFrame, questions: DataFrame) -> DataFrame:
    """What is known of an entity when a question (qid, entity, ts) about it comes: qid, attribute, value, ts, rank.

    For each attribute the newest fact that is no later than the question, in
    chronological order. Every question meets each attribute of its entity
    once; the facts themselves are not joined to the questions.
    """
    about = questions.join(facts.select(*KEY).distinct(), "entity")
    asked = about.select(*KEY, "ts", F.lit(1).alias("kind"), F.col("qid").alias("fact_id"), F.lit(None).cast("struct<value:double,ts:timestamp_ntz,fact_id:long>").alias("held"))
    known = facts.select(*KEY, "ts", F.lit(0).alias("kind"), "fact_id", F.struct("value", "ts", "fact_id").alias("held"))
    order = [F.unix_micros(F.col("ts").cast("timestamp")), F.col("kind"), F.col("fact_id")]
    found = last_known(known.unionByName(asked), KEY, order, "held", "known").where("kind = 1 and known is not null")
    place = Window.partitionBy("qid").orderBy("known.ts", "known.fact_id")
    return found.select(F.col("fact_id").alias("qid"), "attribute", "known").withColumn("rank", F.row_number().over(place)).select("qid", "attribute", "known.value", "known.ts", "rank")


def aged(hits: DataFrame, now: Column, half_life: float) -> DataFrame:
    """Retrieved rows (qid, id, score, ts) by score times one half for each `half_life` days of age before `now`: adds weighted and rank.

    Rows from the future count as new; equal weights go by newer ts, then id.
    """
    days = F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86_400e6)
    weighted = hits.withColumn("weighted", F.col("score") * F.pow(F.lit(0.5), days / half_life))
    order = Window.partitionBy("qid").orderBy(F.round("weighted", 9).desc(), F.desc("ts"), "id")
    return weighted.withColumn("rank", F.row_number().over(order))


_STATE = "attribute array<string>, micros array<long>, fact_id array<long>, value array<double>, changes array<long>, late array<long>"
CHANGE = FACT + ", changes long, late long"


def _follow(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One entity's state: of each attribute its newest fact, how often that changed, and how many facts came too late to matter."""
    held = {a: list(x) for a, *x in zip(*state.get)} if state.exists else {}
    before = {a: x[:2] for a, x in held.items()}
    for rows in batches:
        # Plain numbers, as the state keeps them.
        for attribute, micros, fact_id, value in zip(*(rows[c].tolist() for c in ("attribute", "micros", "fact_id", "value"))):
            x = held.get(attribute)
            if x is None:
                held[attribute] = [micros, fact_id, value, 0, 0]
            elif (micros, fact_id) > (x[0], x[1]):
                x[:3] = micros, fact_id, value
            elif (micros, fact_id) != (x[0], x[1]):
                x[4] += 1
    moved = [a for a, x in held.items() if x[:2] != before.get(a)]
    for a in moved:
        held[a][3] += 1
    state.update(tuple(map(list, zip(*((a, *x) for a, x in held.items())))))
    if moved:
        micros, *rest = zip(*(held[a] for a in moved))
        fact_id, value, changes, late = map(list, rest)
        yield pd.DataFrame({"entity": key[0], "attribute": moved, "ts": np.array(micros, "datetime64[us]"), "fact_id": fact_id, "value": value, "changes": changes, "late": late})


def stream_newest(facts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """A stream of facts to Parquet rows (CHANGE): one for each attribute whose newest fact changed in a batch.

    Facts may come in any order, however late; those older than what is held
    are counted and change nothing, and so do repeated ones. What is there is
    worked off, then it ends; started again with its checkpoint it goes on
    where it ended. newest() of all rows written is the state of the world.
    An entity's attributes share one row of state, as each group costs a call
    with its own frames.
    """
    keyed = facts.withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp"))).where("micros is not null and fact_id is not null")
    moved = keyed.select(*KEY, "micros", "fact_id", "value").groupBy("entity").applyInPandasWithState(_follow, CHANGE, _STATE, "append", GroupStateTimeout.NoTimeout)
    return moved.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out)


def read_facts(spark: SparkSession, path: str, schema: str, fact: list[Column], files: int | None = None) -> DataFrame:
    """Parquet files of `schema`, as they come and at most `files` to a batch, as facts by the columns of `fact`."""
    reader = spark.readStream.schema(schema)
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path).select(*fact)
