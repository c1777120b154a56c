"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken target / source_size times on
average. The whole part of that number is taken from each document; the
fraction is settled by pivotal rounding, which leaves each document's
expectation as it is: two undecided documents exchange mass, weighted by their
sizes so that the words taken stay the same, until one of them is decided.

The exchange runs along a reduction tree. Documents are dealt to groups of
about GROUP by a hash; a group is folded by an ordered aggregate and passes
at most one undecided document on; those are dealt again, until one is left
for each source, which is rounded. A source's words taken thus miss its target
by at most half of one of its documents, and a source with a third of all
documents is just more groups. All draws are hashes of ids and a seed, so that
reruns and retried tasks agree.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, cut, documents, numbered

WEIGHTS, SHARE, CAP, GROUP = (5, 2, 1), 1.5, 2.0, 256
RUN = 4096
_KEY = ("doc_id", "source", "size")
#: With it rows alike in the key are told apart by what they hold, as 128 bits.
_CONTENTS = (*_KEY, "h1", "h2")
_TYPES = {"source": "string"}


def _hashes(docs: DataFrame) -> list[Column]:
    """h1 and h2: 128 bits that stand for a whole row."""
    hashed = lambda f: F.col(f"`{f.name}`").cast("string") if re.search("map|variant", f.dataType.simpleString()) else F.col(f"`{f.name}`")
    columns = [hashed(f) for f in docs.schema]
    return [F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit(1), *columns).alias("h2")]


def _sizes(docs: DataFrame) -> list[Column]:
    return [
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    ]


def sized(docs: DataFrame, contents: bool = False) -> DataFrame:
    """doc_id, source and size (words; 0 for null), with copies told apart by nth (from 1).

    Rows alike in these three, and with `contents` in all their columns (h1 and
    h2 stand for them), are interchangeable, so each is counted and laid out
    again, RUN at a time, so that no array grows with their number.
    """
    key = _CONTENTS if contents else _KEY
    rows = docs.select(*_sizes(docs), *(_hashes(docs) if contents else []))
    counted = rows.groupBy(*key).agg(F.count("*").alias("n"))
    runs = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))
    begun = counted.select(*key, "n", F.explode(F.transform(runs, lambda k: k * RUN)).alias("before"))
    return begun.select(*key, F.explode(F.sequence(F.col("before") + 1, F.least(F.col("n"), F.col("before") + RUN))).alias("nth"))


def targets(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target and rate for each source of `rows` (source, size).

    Sources in code-point order, null last, take `weights` in turn and share
    `share` times all words by weight. Those above `cap` times their own size
    stop there and the excess goes round again, until none is above. Each round
    is one aggregate over the sources; only its two sums reach the driver.
    """
    sums = rows.groupBy("source").agg(F.sum("size").cast("double").alias("source_size"))
    ranked, _ = numbered(sums, [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = cut(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * cap).alias("most")))
    whole = table.agg(F.sum("source_size")).first()[0] or 0.0
    level, stopped = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("weight") * level >= F.col("most")
        row = table.agg(
            F.sum(F.when(full, F.col("most")).otherwise(0.0)),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))),
            F.sum(full.cast("long")),
        ).first()
        if not row[1] or row[2] == stopped:
            break
        level, stopped = (share * whole - row[0]) / row[1], row[2]
    target = F.col("most") if level is None else F.least(F.col("most"), F.col("weight") * level)
    if level is not None and not row[1]:
        target = F.col("most")
    out = table.withColumn("target", target)
    return out.select(
        "source",
        F.col("source_size").cast("long").alias("source_size"),
        "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
    )


def _uniform(*columns: Column) -> Column:
    """A draw from [0, 1), fixed by the columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def _fold(undecided: DataFrame, group: list[str], seed: int, key: tuple[str, ...] = _KEY) -> DataFrame:
    """One level of the tree: `done` (ids with up) and `carry` (at most one) for each group.

    Items are (id, a, p): a hash that names a document's copy, its size and
    its probability to be taken once more.
    """
    own = ",".join(f"{c}:{_TYPES.get(c, 'bigint')}" for c in key)
    item = f"struct<a:double,id:bigint,{own},nth:bigint,p:double>"
    start = F.expr(f"named_struct('c', cast(null as {item}), 'done', cast(array() as array<{item}>))")

    def settled(x: Column, p: Column) -> Column:
        return x.withField("p", p)

    def step(state: Column, x: Column) -> Column:
        c, done = state["c"], state["done"]
        up = F.least((1.0 - c["p"]) * c["a"], x["p"] * x["a"])  # words that c can gain from x
        down = F.least(c["p"] * c["a"], (1.0 - x["p"]) * x["a"])  # words that c can give to x
        gain = _uniform(F.lit(seed), c["id"], x["id"]) * (up + down) < down
        c_wins, c_gives = (1.0 - c["p"]) * c["a"] <= x["p"] * x["a"], c["p"] * c["a"] <= (1.0 - x["p"]) * x["a"]
        c_done = F.when(gain, c_wins).otherwise(c_gives)
        c_p = F.when(gain, c["p"] + up / c["a"]).otherwise(c["p"] - down / c["a"])
        x_p = F.when(gain, x["p"] - up / x["a"]).otherwise(x["p"] + down / x["a"])
        end = F.when(gain, 1.0).otherwise(0.0)  # what c becomes if it is the one decided
        bound = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
        left = F.when(c_done, settled(x, bound(x_p))).otherwise(settled(c, bound(c_p)))
        out = F.when(c_done, settled(c, end)).otherwise(settled(x, 1.0 - end))
        return (
            F.when(c.isNull(), F.struct(x.alias("c"), done.alias("done")))
            .when((c["p"] <= 0.0) | (c["p"] >= 1.0), F.struct(x.alias("c"), F.array_append(done, c).alias("done")))
            .otherwise(F.struct(left.alias("c"), F.array_append(done, out).alias("done")))
        )

    # Large documents first: what stays undecided among many small ones then tends to be small.
    items = F.reverse(F.array_sort(F.collect_list(F.struct("a", "id", *key, "nth", "p"))))
    return undecided.groupBy(*group).agg(items.alias("items")).select(
        *group, F.aggregate("items", start, step).alias("state")
    )


def decide(rows: DataFrame, rates: DataFrame, seed: int = 1, group: int = GROUP) -> DataFrame:
    """`rows` (doc_id, source, size, h1 and h2 if they are told apart by contents, nth) with copies (long): how often each is taken.

    `rates` holds a rate for each source: it is small beside the documents but
    not bounded, so the join is Spark's to plan. Sizes of 0 are taken 0 times.
    """
    key = _CONTENTS if "h1" in rows.columns else _KEY
    rated = rows.join(rates.select(F.col("source").alias("__source"), "rate"), F.col("source").eqNullSafe(F.col("__source")))
    mark = F.xxhash64(F.lit(seed), *key, "nth")
    held = cut(
        rated.select(
            mark.alias("id"), *key, "nth", F.col("size").cast("double").alias("a"),
            F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("p"),
        )
    )
    wanted = held.where("a > 0 and p > 0")
    sizes = wanted.groupBy("source").count()
    most = sizes.agg(F.max("count")).first()[0] or 0
    groups = -(-most // group)  # of the largest source; smaller ones fill theirs less
    waiting, done, level = wanted.drop("whole"), [], 0
    width = F.expr(f"greatest(1, cast(ceil(count / {float(group)}) as bigint))")
    if most:
        spread = sizes.select(F.col("source").alias("__source"), width.alias("__width"))
        waiting = waiting.join(spread, F.col("source").eqNullSafe(F.col("__source"))).withColumn(
            "__group", F.pmod("id", F.col("__width"))
        ).drop("__source", "__width")
    while groups:
        folded = cut(_fold(waiting, ["source", "__group"], seed + level, key).select(
            F.col("source").alias("__source"), "__group", "state"))
        done.append(folded.select(F.explode("state.done").alias("d")).select("d.*"))
        waiting = folded.where("state.c is not null").select("state.c.*", "__group")
        if groups == 1:
            done.append(waiting.drop("__group").withColumn(
                "p", F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0)))
            break
        waiting = waiting.withColumn("__group", F.floor(F.col("__group") / group))
        groups, level = -(-groups // group), level + 1
    out = held.withColumn("more", F.lit(0.0)).select(*key, "nth", "whole", "more")
    for d in done:
        out = out.unionByName(d.select(*key, "nth", F.lit(0).cast("long").alias("whole"), F.col("p").alias("more")))
    return out.groupBy(*key, "nth").agg(
        F.when(F.col("size") > 0, F.sum("whole") + F.sum("more").cast("long")).otherwise(F.lit(0)).cast("long").alias("copies")
    )


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 1, contents: bool = False) -> DataFrame:
    """doc_id, source, size, nth, source_size, target and copies, a row for each row of `docs`.

    A null text has size 0, null sources are a source of their own, and an
    empty table gives an empty result. Rows alike in doc_id, source and size
    are numbered by nth; with `contents` only those alike in all columns are,
    and h1 and h2 stand for these.
    """
    rows = cut(sized(docs, contents))
    table = cut(targets(rows, weights, share, cap))
    taken = decide(rows, table, seed)
    source = table.select(F.col("source").alias("__source"), "source_size", "target")
    return taken.join(source, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 1) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it.

    Which rows are taken is settled over narrow ones, told apart by their
    contents; whole rows are shuffled once, by their hash. Rows alike in all
    columns are one row on the way, so that neither an id nor a text nor a
    missing id is a hot key; where more than RUN copies of such a row are
    taken, they are dealt out again before they are laid out. Null ids, texts
    and sources are values like any other, and an empty table gives none.
    """
    plan = cut(mixed(docs, weights, share, cap, seed, contents=True).groupBy("h1", "h2").agg(F.sum("copies").alias("__copies")).where("__copies > 0"))
    row = F.first(F.struct(*[f"`{c}`" for c in docs.columns])).alias("__row")
    taken = docs.groupBy(*_hashes(docs)).agg(row).join(plan, ["h1", "h2"]).select("__row", "__copies")
    laid = lambda df: df.select("__row", F.explode(F.sequence(F.lit(1).cast("long"), "__copies"))).select("__row.*")
    if not (plan.agg(F.max("__copies")).first()[0] or 0) > RUN:
        return laid(taken)
    begun = F.explode(F.sequence(F.lit(0).cast("long"), "__copies", F.lit(RUN).cast("long"))).alias("__begun")
    runs = taken.where(F.col("__copies") > RUN).select("__row", "__copies", begun)
    dealt = runs.select("__row", F.least(F.lit(RUN), F.col("__copies") - F.col("__begun")).cast("long").alias("__copies")).where("__copies > 0")
    parts = max(8, spark_partitions(docs))
    return laid(taken.where(F.col("__copies") <= RUN)).unionByName(laid(dealt.repartition(parts)))


def spark_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def op9_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixed(documents(spark, sf_dir))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
