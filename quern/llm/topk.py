"""Exact top-k search by integer inner products, in tiles.

Vectors are packed to matrices of at most one Arrow batch where they are read,
and written once. Query blocks and item shards form a grid; in a cell, the
block meets each matrix of the shard in one product, the `k` best of each tile
are selected, and the cell's best lists leave it. The lists of a query then
meet in a tree, a few at a time, until one is left.

The work is that of an exact search, queries times rows. A cell's memory is
fixed by BLOCK, SHARD and SLICE; matrices are shuffled once for each block of
queries and queries once for each shard, both as packed integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

K, SCALE, EVERY = 20, 64, 20
#: Rows of a block of queries and of a shard of items (both about), queries of one product, lists that meet in one merge.
BLOCK, SHARD, SLICE, FAN = 8192, 16384, 256, 8

MOST, ABSENT = 2**63 - 1, -(2**63)
PACKED = "at long, n int, asked int, width int, wide boolean, data binary"
LISTS = "rid long, query_id long, part int, top array<struct<neg: long, blank: boolean, vec_id: long>>"


def _pack(rid: np.ndarray, ids: np.ndarray, blank: np.ndarray, asked: np.ndarray, m: np.ndarray) -> tuple:
    """One matrix with the ids of its rows: (n, asked, width, wide, data)."""
    wide = bool(m.size) and float(np.abs(m).max()) > 32767
    parts = (rid.astype("<i8"), ids.astype("<i8"), blank.astype("u1"), asked.astype("u1"), m.astype("<f8" if wide else "<i2"))
    return len(rid), int(asked.sum()), m.shape[1], wide, b"".join(p.tobytes() for p in parts)


def _unpack(n: int, width: int, wide: bool, data: bytes) -> tuple[np.ndarray, ...]:
    rid, ids = np.frombuffer(data, "<i8", 2 * n).reshape(2, n)
    blank, asked = np.frombuffer(data, "u1", 2 * n, 16 * n).reshape(2, n).astype(bool)
    m = np.frombuffer(data, "<f8" if wide else "<i2", n * width, 18 * n).reshape(n, width).astype(float)
    return rid, ids, blank, asked, m


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["at", "n", "asked", "width", "wide", "data"])


def packed(vectors: DataFrame, asked: Column, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The usable vectors as matrices of floor(scale * x); each row keeps its number, its key and whether it is asked for.

    Null vectors and those holding null or non-finite components are left out.
    Shorter vectors are filled up with zeros, which changes no product.
    """
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.coalesce(asked, F.lit(False)).alias("asked"), v.alias("v"))
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("v").isNotNull() & usable).withColumn("rid", F.monotonically_increasing_id())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(b for b in batches if b.num_rows):
            ids, v = batch.column(0), batch.column(2)
            sizes = v.value_lengths().to_numpy().astype(int)
            m = np.zeros((len(sizes), int(sizes.max())))
            m[np.arange(m.shape[1]) < sizes[:, None]] = np.floor(scale * v.flatten().to_numpy())
            rid = batch.column(3).to_numpy()
            got = _pack(rid, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), m)
            yield _batch([((int(rid[0]) >> 33) + k, *got)])  # the part's number and the matrix's in it deal the matrices evenly

    return rows.select("id", "asked", "v", "rid").mapInArrow(each, PACKED)


def _queries(matrices: DataFrame, block: int) -> DataFrame:
    """The asked rows of the matrices, in matrices of at most `block` rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rid, ids, blank, asked, m = _unpack(row["n"], row["width"], row["wide"], row["data"])
                own = np.flatnonzero(asked)
                for at in range(0, len(own), block):
                    some = own[at : at + block]
                    yield _batch([(row["at"], *_pack(rid[some], ids[some], blank[some], asked[some], m[some]))])

    return matrices.where("asked > 0").mapInArrow(each, PACKED)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integers held as doubles, (queries, items); beyond a long they stay at its end."""
    width = max(q.shape[1], x.shape[1], 1)
    q, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, x))
    safe = np.sqrt(2.0**53 / width) - 1
    a, b = np.abs(q).max(axis=1, initial=0), np.abs(x).max(axis=1, initial=0)
    if a.max(initial=0) * b.max(initial=0) * width < 2.0**53:
        return (q @ x.T).astype(np.int64)
    out = (np.where(a[:, None] <= safe, q, 0) @ np.where(b[:, None] <= safe, x, 0).T).astype(np.int64)
    whole = lambda row: [int(c) for c in row]
    far = np.flatnonzero(b > safe)
    for i in range(len(q)):  # vectors of very large components, by Python's integers
        row = whole(q[i])
        for j in range(len(x)) if a[i] > safe else far:
            out[i, j] = max(-MOST, min(MOST, sum(s * t for s, t in zip(row, whole(x[j])))))
    return out


def selected(scores: np.ndarray, k: int) -> np.ndarray:
    """True at the `k` highest of each row, ties to earlier columns; never at ABSENT."""
    n = scores.shape[1]
    if n <= k:
        return scores != ABSENT
    least = np.partition(scores, n - k, axis=1)[:, n - k : n - k + 1]
    above, ties = scores > least, scores == least
    return (above | (ties & (np.cumsum(ties, axis=1) <= k - above.sum(axis=1, keepdims=True)))) & (scores != ABSENT)


def _cell(k: int):
    def best(key: tuple, items: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        for asked in queries.to_pylist():
            rid, ids, _, _, q = _unpack(asked["n"], asked["width"], asked["wide"], asked["data"])
            for tile in items.to_pylist():
                of, keys, blank, _, x = _unpack(tile["n"], tile["width"], tile["wide"], tile["data"])
                order = np.lexsort((keys, blank))  # ties go to smaller keys, null ones last
                of, keys, blank, x = of[order], keys[order], blank[order], x[order]
                place = {int(r): j for j, r in enumerate(of)}
                for at in range(0, len(q), SLICE):
                    scores = products(q[at : at + SLICE], x)
                    for i, r in enumerate(rid[at : at + SLICE]):
                        if (j := place.get(int(r))) is not None:
                            scores[i, j] = ABSENT
                    i, j = np.nonzero(selected(scores, k))
                    found.append((rid[at + i], ids[at + i], -scores[i, j], blank[j], keys[j]))
        if not found:
            return pa.Table.from_pylist([], _lists())
        rid, ids, neg, blank, keys = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((keys, blank, neg, rid))
        rid, ids, neg, blank, keys = (c[order] for c in (rid, ids, neg, blank, keys))
        first = np.flatnonzero(np.r_[True, rid[1:] != rid[:-1]][: len(rid)])
        nth = np.arange(len(rid)) - np.repeat(first, np.diff(np.r_[first, len(rid)]))
        keep = nth < k
        rid, ids, neg, blank, keys = (c[keep] for c in (rid, ids, neg, blank, keys))
        first = np.flatnonzero(np.r_[True, rid[1:] != rid[:-1]][: len(rid)])
        entries = pa.StructArray.from_arrays([pa.array(neg), pa.array(blank), pa.array(keys, mask=blank)], ["neg", "blank", "vec_id"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(rid)], pa.int32()), entries)
        part = np.full(len(first), key[1].as_py(), np.int32)
        return pa.Table.from_arrays([pa.array(rid[first]), pa.array(ids[first]), pa.array(part), lists], schema=_lists())

    return best


def _lists() -> pa.Schema:
    entry = pa.struct([("neg", pa.int64()), ("blank", pa.bool_()), ("vec_id", pa.int64())])
    return pa.schema([("rid", pa.int64()), ("query_id", pa.int64()), ("part", pa.int32()), ("top", pa.list_(entry))])


def search(
    vectors: DataFrame, asked: Column, k: int = K, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE,
    block: int = BLOCK, shard: int = SHARD, fan: int = FAN,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the `k` rows of highest score for each row that is `asked` for.

    The score is the inner product of floor(scale * x); ties go to the smaller
    key, null keys last. All rows with a usable vector but the query's own are
    candidates, also such with its key: of repeated rows each is asked for by
    itself and finds the others. Queries with no other row have no result, and
    an empty table gives an empty one. Scores beyond a long stay at its end.
    """
    matrices = cut(packed(vectors, asked, key, vector, scale))
    rows, wanted = matrices.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("asked"), F.lit(0))).first()
    blocks, shards = max(1, -(-wanted // block)), max(1, -(-rows // shard))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n: F.pmod("at", F.lit(n)).cast("int")
    columns = ["n", "width", "wide", "data"]
    items = matrices.select(each(blocks).alias("b"), deal(shards).alias("s"), *columns)
    queries = _queries(matrices, block).select(deal(blocks).alias("b"), "at", *columns).select("b", each(shards).alias("s"), *columns)
    lists = items.groupBy("b", "s").cogroup(queries.groupBy("b", "s")).applyInArrow(_cell(k), LISTS)
    while shards > 1:
        shards = -(-shards // fan)
        together = F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, k).alias("top")  # of `fan` lists at most
        lists = lists.groupBy("rid", "query_id", F.floor(F.col("part") / fan).cast("int").alias("part")).agg(together)
    top = lists.select("query_id", F.posexplode("top").alias("place", "e"))
    return top.select("query_id", (F.col("place") + 1).alias("rank"), F.col("e.vec_id").alias("vec_id"), (-F.col("e.neg")).alias("score"))


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % EVERY == 0)


SQL = """WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 20"""
