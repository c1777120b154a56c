"""Sizes, targets and copies of the source mix, computed a second time."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.llm import mixing


def targets(sizes):
    """Words by source -> target by source: the excess over twice a source's size goes round until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    whole, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = sum(weight[s] for s in order if s not in full)
        left = whole - sum(2 * sizes[s] for s in full)
        out = {s: 2 * sizes[s] if s in full else left * weight[s] / rest for s in order}
        above = {s for s in order if s not in full and out[s] >= 2 * sizes[s]}
        if not above:
            return out
        full |= above
        if len(full) == len(order):
            return {s: 2 * sizes[s] for s in order}


def check(docs, rows):
    """`rows` of the mix against `docs` (doc_id, source, text)."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in rows) == Counter((d, s, size(t)) for d, s, t in docs)
    sizes = Counter()
    for _, s, t in docs:
        sizes[s] += size(t)
    want = targets(sizes)
    taken, most = Counter(), Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["copies"] <= 2 and (r["size"] or not r["copies"])
        rate = want[r["source"]] / max(1, sizes[r["source"]])
        assert not r["size"] or abs(r["copies"] - rate) < 1  # the whole part always, the fraction by a draw
        taken[r["source"]] += r["copies"] * r["size"]
        most[r["source"]] = max(most[r["source"]], r["size"])
    assert all(abs(taken[s] - want[s]) <= most[s] for s in sizes)


def test_op9_second_computation(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check([(r["doc_id"], r["source"], r["text"]) for r in docs.collect()], mixing.mixed(docs).collect())
    got = mixing.op9_mixing_sources(spark, sf_dir).collect()
    assert sum(r["taken"] for r in got) == sum(r["copies"] * r["size"] for r in mixing.mixed(docs).collect())


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "b", "a b c", 9), (1, "b", "d e f", 8), (1, "b", "a b c", 9), (None, "b", "x", 1), (None, None, "y z", 1), (2, None, None, 1), (3, "é", "", 1), (4, "z", "w " * 500, 2)]
    rows += [(7, "hot", "same four words here", 3)] * 9000 + [(i, "c", f"t {i}", 0) for i in range(100, 150)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, copies int")


def test_odd_rows(odd):
    docs = [(r["doc_id"], r["source"], r["text"]) for r in odd.collect()]
    check(docs, mixing.mixed(odd).collect())
    assert sorted(map(repr, mixing.mixed(odd).collect())) == sorted(map(repr, mixing.mixed(odd.repartition(7)).collect()))


def test_mix_repeats_whole_rows(odd):
    got, rows = mixing.mix(odd), odd.collect()
    assert got.dtypes == odd.dtypes
    out = Counter(tuple(r) for r in got.collect())
    assert all(0 < n <= 2 * rows.count(k) for k, n in out.items())
    words = lambda t: len((t or "").split())
    by = Counter()
    for r in mixing.mixed(odd, contents=True).collect():
        by[r["doc_id"], r["source"], r["size"]] += r["copies"]
    again = Counter()
    for (d, s, t, _), n in out.items():
        again[d, s, words(t)] += n
    assert +by == again


def test_rows_without_ids_and_hot_rows(spark):
    """All ids null, further columns that alone tell rows apart, maps among them, and one row more often than RUN."""
    rows = [(None, "a", f"word {i % 7} more", {"k": i % 5}) for i in range(200)] + [(None, None, "the same words", None)] * (2 * mixing.RUN)
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, extra map<string,int>")
    plain = lambda r: (*r[:3], tuple(sorted((r[3] or {}).items())))
    own, out = Counter(map(plain, docs.collect())), Counter(map(plain, mixing.mix(docs).collect()))
    assert all(0 < n <= 2 * own[k] for k, n in out.items())
    by = Counter()
    for r in mixing.mixed(docs, contents=True).collect():
        by[r["source"]] += r["copies"] * r["size"]
    again = Counter()
    for (_, s, t, _), n in out.items():
        again[s] += n * len(t.split())
    assert again == +by and max(out.values()) > mixing.RUN


def test_empty(odd):
    empty = odd.limit(0)
    assert mixing.mixed(empty).collect() == [] and mixing.mix(empty).collect() == []


def test_runs_are_bounded(odd):
    got = mixing.sized(odd).where("source = 'hot'").agg(F.count("*").alias("n"), F.countDistinct("nth").alias("d"), F.max("nth").alias("m")).first()
    assert tuple(got) == (9000, 9000, 9000)
