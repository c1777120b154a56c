"""The packing search against all fillings and all packings of small instances."""

import random
from collections import Counter
from functools import lru_cache
from itertools import product
from pathlib import Path

import pytest

from quern.llm import packing as P


def bags(counts):
    """All multisets that `counts` hold."""
    sizes = sorted(counts)
    for picks in product(*[range(counts[s] + 1) for s in sizes]):
        yield tuple(s for s, k in sorted(zip(sizes, picks), reverse=True) for _ in range(k))


def swapped(filling, counts, room):
    """Whether one piece left may stand for one smaller or for several of the filling's, within the room."""
    free = Counter(counts) - Counter(filling)
    for part in bags(Counter(filling)):
        for x in free:
            if part and sum(part) <= x and sum(filling) - sum(part) + x <= room and (len(part) > 1 or x > part[0]):
                return True
    return False


@pytest.mark.parametrize("seed", range(12))
def test_undominated_fillings(seed):
    rng = random.Random(seed)
    counts = Counter(rng.choices(range(2, 15), k=8))
    room = rng.randint(8, 24)
    want = {f for f in bags(counts) if sum(f) <= room and not swapped(f, counts, room)}
    # A filling with room for a further piece is left out by itself, as the empty part may be swapped for it.
    want = {f for f in want if not any(sum(f) + x <= room for x in Counter(counts) - Counter(f))}
    got = [f for f in P.fillings(counts, room, room) if f is not None]
    assert [sum(f) for f in got] == sorted((sum(f) for f in got), reverse=True) and len(set(got)) == len(got)
    assert {f for f in got if not any(sum(f) + x <= room for x in Counter(counts) - Counter(f))} == want


def fewest(counts, capacity):
    sizes = tuple(sorted((s for s, n in counts.items() for _ in range(n)), reverse=True))

    @lru_cache(None)
    def least(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        best = len(left)
        for f in {f for f in bags(Counter(rest)) if sum(f) <= capacity - first}:
            best = min(best, 1 + least(tuple(sorted((Counter(rest) - Counter(f)).elements(), reverse=True))))
        return best

    return least(sizes)


@pytest.mark.parametrize("seed", range(15))
def test_optimal_on_small_instances(seed):
    rng = random.Random(100 + seed)
    capacity = rng.randint(20, 40)
    counts = Counter(rng.choices(range(3, capacity), k=9))
    plan = P.complete_bins(counts, capacity)
    assert sum((Counter({s: f.count(s) * n for s in f}) for f, n in plan), Counter()) == counts and all(sum(f) <= capacity for f, _ in plan)
    assert P.bins_of(plan) == fewest(counts, capacity) >= P.least_bins(counts, capacity)


def test_search_without_limit_is_exact():
    rng = random.Random(2)
    for _ in range(20):
        counts = Counter(rng.choices(range(5, 28), k=8))
        best = fewest(counts, 40)
        assert P.search(counts, 40, best, 10**6)[0] is not None and P.search(counts, 40, best - 1, 10**6)[0] is None


@pytest.fixture(scope="module")
def lengths(spark, sf_dir):
    """The lengths of the pieces of a thousand documents, or of the tests' own tables where those aren't there."""
    path = Path(sf_dir).parent / "sf0.01" / "documents.parquet"
    docs = spark.read.parquet(str(path) if path.exists() else f"{sf_dir}/documents.parquet").repartition(8)
    return Counter({r["length"]: r["count"] for r in P.pieces(docs).groupBy("length").count().collect()})


@pytest.mark.parametrize("k", [3, 1000, 10**6])
def test_times_the_counts_at_most_times_the_bins(lengths, k):
    bins = P.bins_of(P.complete_bins(lengths))
    many = {s: n * k for s, n in lengths.items()}
    plan = P.complete_bins(many)
    print("times", k, "bins", P.bins_of(plan), "bound", P.least_bins(Counter(many), 1024))
    assert P.bins_of(plan) <= k * bins
    assert sum((Counter({s: f.count(s) * n for s in set(f)}) for f, n in plan), Counter()) == many


@pytest.mark.parametrize("seed", range(3))
def test_large_counts_in_a_smaller_scale(seed):
    """Counts without a common divisor: all pieces are packed, in no more bins than best-fit takes."""
    rng = random.Random(seed)
    counts = Counter({s: rng.randint(1, 3000) for s in rng.sample(range(20, 400), 40)})
    plan = P.complete_bins(counts, 400, nodes=600, small=500)
    assert sum((Counter({s: f.count(s) * n for s in set(f)}) for f, n in plan), Counter()) == counts and all(sum(f) <= 400 for f, _ in plan)
    assert P.least_bins(counts, 400) <= P.bins_of(plan) <= P.bins_of(P.best_fit(counts, 400))


def test_fewer_than_best_fit_on_documents(lengths):
    counts = lengths
    plan = P.complete_bins(counts)
    print("bins", P.bins_of(plan), "best fit", P.bins_of(P.best_fit(counts, 1024)), "bound", P.least_bins(counts, 1024))
    assert P.bins_of(plan) < P.bins_of(P.best_fit(counts, 1024)) and P.complete_bins(dict(sorted(counts.items()))) == plan
    assert sum((Counter({s: f.count(s) * n for s in set(f)}) for f, n in plan), Counter()) == counts


def test_rows_without_ids(spark):
    """All ids null: the rows are spread over the salts and find places of their own."""
    docs = spark.createDataFrame([(None, "same text")] * 3000 + [(None, f"text number {i}") for i in range(500)], "doc_id long, text string")
    got = P.packed(docs).collect()
    assert len(got) == 3500 and len({(r["sequence_id"], r["offset"]) for r in got}) == 3500
    seq = {}
    for r in got:
        seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in places) <= 1024 and {0, *(a + n for a, n in places)} > {a for a, _ in places} for places in seq.values())
    assert P.packed(docs.limit(0)).collect() == []


def test_awkward_rows(spark):
    rows = [(1, None, 5, "a"), (1, None, 5, "a"), (None, "", 6, "b"), (2, "word " * 3000, 7, "c")] + [(i, "same text", 1, "d") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int, sequence_id string")
    got = P.packed(docs).collect()
    whole = Counter((r["doc_id"], r["piece"]) for r in got)
    assert whole[1, 0] == 3 and whole[None, 0] == 1 and sum(k[0] == 2 for k in whole) == 3 and len(got) == 305 + 1
    seq = {}
    for r in got:
        seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
