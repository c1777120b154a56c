"""Vector expressions and exact similarity joins in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 for two empty ones."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def char_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))


def string_similarity(a: Column, b: Column) -> Column:
    """0.9 where one contains the other, else the Jaccard similarity of their character sets; case is ignored."""
    x, y = F.lower(a), F.lower(b)
    return F.when(x.contains(y) | y.contains(x), 0.9).otherwise(jaccard(char_set(x), char_set(y)))


def held(df: DataFrame, vector: str) -> Column:
    """A vector column as it travels: single precision stays, which doubles in the task tell exactly; all else are doubles."""
    v = F.col(vector)
    return v if df.schema[vector].dataType.simpleString() == "array<float>" else as_double(v)


def blocks(df: DataFrame, key: str, size: int = 1024) -> tuple[DataFrame, int]:
    """`df` with a block number that spreads rows evenly; blocks hold about `size` rows."""
    n = max(1, -(-df.count() // size))
    return df.withColumn("block", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")), n


def similar_pairs(df: DataFrame, key: str, vector: str, low: float, high: float = 2.0, size: int = 8192, strip: int = 1024) -> DataFrame:
    """Pairs a < b of `key` with low <= cosine < high, as (a, b, sim).

    An exact join in blocks: each pair of blocks meets once, as two matrices of
    at most about `size` rows, whose products are taken `strip` rows at a time,
    so that a task's memory is fixed and only passing pairs leave it. The work
    is quadratic in the number of blocks, which an exact threshold join on
    dense vectors needs; the rows shuffled are `df` times the number of blocks,
    so blocks are as large as a task can hold.
    """
    rows, n = blocks(df.select(F.col(key).alias("id"), held(df, vector).alias("v")), "id", size)
    kind = df.schema[key].dataType.simpleString()
    left = rows.select("id", "v", F.explode(F.sequence(F.col("block"), F.lit(n - 1))).alias("other"), F.col("block").alias("mine")).select(
        "id", "v", F.col("mine").alias("i"), F.col("other").alias("j"), F.lit(0).alias("side")
    )
    right = rows.select("id", "v", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j")).select(
        "id", "v", "i", "j", F.lit(1).alias("side")
    )

    def meet(parts: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for s in (0, 1):
            own = parts[parts["side"] == s]
            m = np.array(own["v"].tolist(), float).reshape(len(own), -1)
            length = np.linalg.norm(m, axis=1, keepdims=True)
            sides.append((own["id"].to_numpy(), m / np.where(length == 0, 1, length)))
        (ida, a), (idb, b) = sides
        if not len(ida) or not len(idb):
            return pd.DataFrame({"a": ida[:0], "b": idb[:0], "sim": np.zeros(0)})
        same, found = parts["i"].iloc[0] == parts["j"].iloc[0], []
        for k in range(0, len(a), strip):
            sims = a[k : k + strip] @ b.T
            i, j = np.nonzero((sims >= low) & (sims < high))
            x, y = ida[k + i], idb[j]
            keep = x < y if same else x != y
            x, y, s = x[keep], y[keep], sims[i, j][keep]
            found.append(pd.DataFrame({"a": np.where(x < y, x, y), "b": np.where(x < y, y, x), "sim": s}))
        return pd.concat(found)

    return left.unionByName(right).groupBy("i", "j").applyInPandas(meet, f"a {kind}, b {kind}, sim double")


def top_by_cosine(queries: DataFrame, items: DataFrame, k: int, query_key: str, item_key: str, vector: str, size: tuple[int, int] = (8192, 8192)) -> DataFrame:
    """The `k` items of highest cosine for each query (ties by item key): query, item, score, rank.

    Queries and items are dealt to blocks of about `size` rows; each two blocks
    meet once as matrices, and the `k` best of a block go on to the ranks. No
    number of queries or items is too many, none passes through the driver,
    and a task's memory is fixed; the work is queries times items, and so are
    the rows shuffled, over the blocks' sizes. A vector
    without length has cosine 0 with all; queries have distinct keys.
    """
    (asked, n), (rows, m) = (
        blocks(df.select(F.col(key).alias("id"), held(df, vector).alias("v")), "id", many)
        for df, key, many in ((queries, query_key, size[0]), (items, item_key, size[1]))
    )
    qkind, ikind = queries.schema[query_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    every = lambda blocks_: F.explode(F.sequence(F.lit(0), F.lit(blocks_ - 1)))
    left = asked.select("id", "v", F.col("block").alias("i"), every(m).alias("j")).groupBy("i", "j")
    right = rows.select("id", "v", every(n).alias("i"), F.col("block").alias("j")).groupBy("i", "j")

    def unit(part: pd.DataFrame) -> np.ndarray:
        m = np.array(part["v"].tolist(), float).reshape(len(part), -1)
        length = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(length == 0, 1, length)

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query": a["id"].iloc[:0], "item": b["id"].iloc[:0], "score": np.zeros(0)})
        q, x, ids, keys = unit(a), unit(b), a["id"].to_numpy(), b["id"].to_numpy()
        found = []
        for at in range(0, len(q), 256):
            sims = q[at : at + 256] @ x.T
            order = np.lexsort((np.broadcast_to(keys, sims.shape), -np.round(sims, 9)), axis=1)[:, :k]
            r, c = np.repeat(np.arange(len(sims)), order.shape[1]), order.ravel()
            found.append(pd.DataFrame({"query": ids[at + r], "item": keys[c], "score": sims[r, c]}))
        return pd.concat(found)

    found = left.cogroup(right).applyInPandas(best, f"query {qkind}, item {ikind}, score double")
    return ranked(found, "query", [F.round("score", 9).desc(), F.col("item")], k)


def ranked(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first `k` rows of each group with their rank."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("rank", place).where(F.col("rank") <= k)


def min_max(value: Column, over) -> Column:
    """Scaled to [0, 1] within a window; a constant list becomes 0."""
    low, high = F.min(value).over(over), F.max(value).over(over)
    return F.when(high > low, (value - low) / (high - low)).otherwise(0.0)
