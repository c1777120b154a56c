"""Neighbours in id order and block borders of the document fingerprints."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.llm import weighted_sampling as W


def by_order(spark, rows):
    """The rows in the operator's order, from a plain sort of the hashes that Spark gives."""
    hashes = {r["t"]: r["h"] for r in spark.createDataFrame([(t or "",) for _, t in rows], "t string").distinct().select("t", F.xxhash64("t").alias("h")).collect()}
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1] or ""]))


TABLES = {
    "outlier": [(i, f"text {i}") for i in range(3000)] + [(1 << 60, "far"), (-(1 << 62), "other end")],
    "no ids": [(None, f"text {i % 700}") for i in range(3000)] + [(1, "one"), (2, None)],
    "one id": [(5, f"text {i}") for i in range(3000)],
    "repeated": [(7, "same text")] * 2500 + [(i, f"t{i}") for i in range(40)] + [(None, None)] * 3,
    "extremes": [(-(1 << 63), "least"), ((1 << 63) - 1, "most"), (0, ""), (None, "none")],
    "lone": [(3, "abc def")],
    "lone null": [(None, None)],
}


@pytest.mark.parametrize("name", TABLES)
def test_neighbours(spark, name, monkeypatch):
    rows = TABLES[name]
    order = by_order(spark, rows)
    shuffled = rows[:]
    random.Random(4).shuffle(shuffled)
    docs = spark.createDataFrame(shuffled, "doc_id long, text string").repartition(5).cache()
    monkeypatch.setattr(W.borders, "__defaults__", (100, 1 << 15, 3))
    got = W.edited(docs).collect()
    want = Counter()
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        want[i, t, after, t[: len(t) - n] + after[:n]] += 1
    assert Counter((r["doc_id"], r["text"], r["next"], r["edited"]) for r in got) == want
    sizes = Counter(r["block"] for r in got)
    assert max(sizes.values()) <= 600 and (len(rows) < 1000 or len(sizes) > 15)
    docs.unpersist()


def test_borders_are_bounded(spark):
    rows = W.keyed(spark.range(20_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")))
    cuts = W.borders(rows, size=10, most=27)
    assert 15 <= len(cuts) <= 27
    sizes = [r["count"] for r in rows.groupBy(W.block_of(F.col("key"), cuts)).count().collect()]
    assert len(sizes) == len(cuts) + 1 and max(sizes) < 4 * 20_000 / len(sizes)


def test_tasks_hold_few_blocks(spark, monkeypatch):
    """A task's words must not grow with the table: rows are dealt to more tasks where there are more blocks."""
    monkeypatch.setattr(W.borders, "__defaults__", (100, 1 << 15, 3))
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("text"), "id").alias("text"))
    sizes = [r["count"] for r in W.edited(docs).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 6000 and max(sizes) < 1000


@pytest.mark.parametrize("n", [0, 1, 2, 7, 8, 9, 27, 40])
def test_block_of(spark, n):
    cuts = [f'{{"n":false,"i":{i},"h":{h},"m":0}}' for i in range(-3, 20) for h in (-5, 5)][:n]
    keys = [(i, h) for i in range(-5, 22) for h in (-6, -5, 0, 5, 6)]
    frame = spark.createDataFrame(keys, "i long, h long").select("i", "h", F.struct(F.lit(False).alias("n"), "i", "h", F.lit(0).cast("long").alias("m")).alias("key"))
    borders = [(i, h) for i in range(-3, 20) for h in (-5, 5)][:n]
    for r in frame.select("i", "h", W.block_of(F.col("key"), cuts).alias("b")).collect():
        assert r["b"] == sum(b <= (r["i"], r["h"]) for b in borders)


def test_op5_digests(spark, sf_dir):
    """n_chars, edited_sha256 and equal fingerprints for equal texts; likeness as the share of equal draws."""
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    order = sorted(docs, reverse=True)
    got = {r["doc_id"]: r for r in W.op5_document_fingerprints(spark, sf_dir).collect()}
    share = lambda a, b: sum(a[i : i + 8] == b[i : i + 8] for i in range(0, len(a), 8)) / (len(a) / 8)
    same = {}
    for k, i in enumerate(order):
        nxt = order[(k + 1) % len(order)]
        n = len(docs[i]) // 3
        edit = docs[i][: len(docs[i]) - n] + docs[nxt][:n]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(docs[i]), hashlib.sha256(edit.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(share(r["fingerprint"], r["edited_fingerprint"]))
        assert r["near_next"] == pytest.approx(share(r["fingerprint"], got[nxt]["fingerprint"]))
        assert same.setdefault(docs[i], r["fingerprint"]) == r["fingerprint"]
