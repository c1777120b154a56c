"""Hand-worked cases of metrics, and the stream against its batch twin."""

import pytest
from pyspark.sql import functions as F

from quern.functions import metrics as M
from quern.streaming.events import hourly, stream_hourly

CASES = [
    ("hit", ["doc1", "doc2", "doc3"], ["doc1", "doc4"], 1.0),
    ("hit", ["doc2", "doc3"], ["doc1", "doc4"], 0.0),
    ("hit", ["doc1", "doc2"], [], 0.0),
    ("mrr", ["doc2", "doc1"], ["doc1"], 0.5),
    ("mrr", ["doc2"], ["doc1"], 0.0),
    ("recall", ["doc1", "doc2", "doc3"], ["doc1", "doc4"], 0.5),
    ("precision", ["doc1", "doc2", "doc3"], ["doc1", "doc4"], 1 / 3),
    ("f1", ["doc1", "doc2", "doc3"], ["doc1", "doc4"], 0.4),
    ("f1", [], [], 0.0),
]


@pytest.mark.parametrize("name, got, truth, want", CASES)
def test_metrics(spark, name, got, truth, want):
    row = spark.createDataFrame([(got, truth)], "a array<string>, b array<string>")
    assert row.select(M.metric(name)(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)


def test_rouge_l(spark):
    row = spark.createDataFrame([("a b c d".split(), "a x c d".split()), ([], ["a"]), (None, None)], "a array<string>, b array<string>")
    assert [r[0] for r in row.select(M.lcs_length("a", "b")).collect()] == [3, 0, 0]


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream_hourly(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in hourly(events).collect()}
    assert got and got <= want and len(got) >= 0.9 * len(want)  # the last hours are still open


def test_rouge_l_of_all_pairs(spark, sf_dir):
    """Every row of the query against the usual table of common subsequences."""
    import re

    from quern.plans import catalogue, reports

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before, row = row, [0]
            for j, y in enumerate(b):
                row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
        return row[-1]

    words = lambda t: re.findall(r"[a-z0-9_]+", (t or "").lower())
    got = {r["key"]: r["rouge_l"] for r in catalogue.queries()["rouge_l"](spark, sf_dir).collect()}
    pairs = reports._pairs(spark, sf_dir).collect()
    assert len(got) == len(pairs) > 0
    for r in pairs:
        a, t = words(r["answer"]), words(r["truth"])
        n = common(a, t)
        assert got[r["key"]] == pytest.approx(2 * n / (len(a) + len(t)) if n else 0.0, abs=1e-6)
