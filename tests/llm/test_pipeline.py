"""The pipeline's stages by contents, on odd rows, and the pipeline as a whole."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import mixing, packing, quality, secret_scan, simhash

STAGES = dict(corpus_pipeline.STAGES)
LONG = "lorem ipsum dolor sit amet " * 4000
TEXTS = [None, "", " \n\t", "one", "one two", LONG, "same text here now", "same text here now", "Ünïcode 漢字 straße", "x" * 5000, "token = abcdefghijkl123 and more"]


@pytest.fixture(scope="module")
def odd(spark, sf_dir):
    """The documents, and rows with nulls, empty and long texts, repeated rows and ids, and columns whose names the operators use."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 3 = 0")
    more = [(9000 + i, t, "en", "ab"[i % 2] if i % 3 else None, len(t or "")) for i, t in enumerate(TEXTS)]
    more += [more[6], more[6], (None, "no id at all", None, None, None), (None, "another without id", None, "a", 3), (9004, "same id, other text entirely", "en", "a", 9)]
    rows = docs.unionByName(spark.createDataFrame(more, docs.schema))
    names = ("score", "predicted", "__quality", "component_id", "fp", "spans", "copies", "nth", "size", "length", "piece", "target", "row")
    return rows.select("*", *[F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in names]).cache()


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", STAGES)
def test_empty_table(spark, odd, sf_dir, name):
    empty = odd.limit(0)
    out = STAGES[name](spark, empty, sf_dir)
    assert out.collect() == [] and (name == "best_fit_packing" or out.dtypes == empty.dtypes)


def test_quality_filter(spark, odd, sf_dir):
    kept = STAGES["quality_classifier"](spark, odd, sf_dir)
    assert kept.dtypes == odd.dtypes
    scores = {r["text"]: r["s"] for r in quality.fit_on_labels(spark, odd, sf_dir).score(odd.select("text"), "s").collect()}
    at = odd.columns.index("text")
    assert rows_of(kept) == Counter({k: n for k, n in rows_of(odd).items() if scores[k[at]] >= quality.THRESHOLD})


def test_near_dedup(spark, odd, sf_dir):
    kept = STAGES["simhash_near_dedup"](spark, odd, sf_dir)
    assert kept.dtypes == odd.dtypes
    fps = {r["text"]: simhash.fingerprint_of(r["text"]) for r in odd.select("text").distinct().collect()}
    names = list(set(fps.values()))
    root = {f: f for f in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for r in odd.collect():
        group = find(fps[r["text"]])
        key = (r["doc_id"] is None, r["doc_id"] or 0)
        if group not in least or key < least[group]:
            least[group] = key
    got = {find(fps[r["text"]]): (r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()}
    assert got == least and kept.count() == len(least) and not rows_of(kept) - rows_of(odd)


def test_mask_secrets(spark, odd, sf_dir):
    got = STAGES["secret_scans"](spark, odd, sf_dir)
    assert got.dtypes == odd.dtypes
    text, chars = odd.columns.index("text"), odd.columns.index("n_chars")
    want = Counter()
    for r, n in rows_of(odd).items():
        new = None if r[text] is None else secret_scan.redacted_text(r[text])
        want[(*r[:text], new, *r[text + 1 : chars], r[chars] if new == r[text] or len(new) == len(r[text]) else len(new), *r[chars + 1 :])] += n
    assert rows_of(got) == want and any("[REDACTED]" in (k[text] or "") for k in want)


def test_mix_sources(spark, odd, sf_dir):
    got = STAGES["mixing_sources"](spark, odd, sf_dir)
    assert got.dtypes == odd.dtypes
    own, out = rows_of(odd), rows_of(got)
    assert all(n <= 2 * own[k] for k, n in out.items())
    i, s, t = (odd.columns.index(c) for c in ("doc_id", "source", "text"))
    taken, again = Counter(), Counter()
    for r in mixing.mixed(odd, contents=True).collect():
        taken[r["doc_id"], r["source"], r["size"]] += r["copies"]
    for k, n in out.items():
        again[k[i], k[s], len((k[t] or "").split())] += n
    assert sum(again.values()) == sum(taken.values())
    assert again == +taken


def test_run_whole(spark, odd, sf_dir, tmp_path):
    """run() on odd rows gives what the stages give one after the other, each written and read again."""
    docs = odd.drop("piece", "length")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    step = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, step, str(tmp_path)).write.parquet(str(tmp_path / f"s{k}"))
        step = spark.read.parquet(str(tmp_path / f"s{k}"))
        assert step.columns == docs.columns
    pieces = packing.pieces(step).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert Counter(map(key, got)) == Counter(map(key, pieces)) and got
    seq = {}
    for r in got:
        seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
