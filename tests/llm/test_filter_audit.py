"""The filter audit against filters applied one after the other."""

from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from quern.llm import filter_audit as A

SCHEMA = "doc_id long, text string, source string, part string, fails int, n long"


def failing(docs):
    """The set of letters that each row fails."""
    out = []
    for doc_id, text, *_ in docs:
        t = text or ""
        words = [w for w in t.replace("\t", " ").replace("\n", " ").split(" ") if w]
        own = set()
        own |= {"A"} if len(words) < 200 else set()
        own |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        own |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t) else set()
        own |= {"D"} if any(c in "#$%&*|" for c in t) else set()
        own |= {"E"} if doc_id is not None and any(i is not None and i < doc_id and (x or "") == t for i, x, *_ in docs) else set()
        out.append(own)
    return out


def brute(docs, labels):
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in (0, 1))
    fails, want = failing(docs), {}
    for part in {d[2] or "" for d in docs}:
        own = [(d[0], f) for d, f in zip(docs, fails) if (d[2] or "") == part]
        total = Counter()
        for order in permutations("ABCDE"):
            left = own
            for k, letter in enumerate(order):
                gone = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                total[letter] += len(gone)
                want[part, "".join(order), k + 1] = [
                    len(left), len(gone), sum(letter in f for _, f in own) - len(gone), sum(f == {letter} for _, f in own),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ]
        for (p, order, k), row in want.items():
            if p == part:
                row.append(total[order[k - 1]])
    return want


LONG = " ".join(f"word{i}" for i in range(220))
DOCS = [
    (1, LONG, "a"), (2, LONG, "a"), (3, LONG, "b"), (3, LONG, "b"), (None, LONG, "a"), (4, None, None), (5, "", ""), (6, "LOUD & short", "a"),
    (7, "same " * 300, "b"), (7, "same " * 300, "b"), (8, LONG + " SHOUTING AND MORE SHOUTING THAN IS GOOD FOR A TEXT OF THIS LENGTH", "b"), (9, LONG + " 5%", None), (0, "\t \n", "c"), (None, None, "c"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, 1, 1), (6, None, 1), (None, 1, 1), (99, 1, 1)]


def got(df):
    return {(r[0], r[1], r[2]): list(r[3:]) for r in df.collect()}


def test_odd_rows_by_filters_in_turn(spark):
    docs = spark.createDataFrame([(*d, "clash", 31, 5) for d in DOCS], SCHEMA)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert got(A.audit(A.contingency(docs, labels))) == brute(DOCS, LABELS)


def test_many_parts_and_one_text_everywhere(spark):
    rng = np.random.default_rng(5)
    texts = [LONG, LONG.upper(), "x " * 250, "few words", "few # words", *[LONG + f" {i}" for i in range(20)]]
    docs = [(int(i), texts[0] if rng.random() < 0.4 else texts[rng.integers(len(texts))], f"p{rng.integers(A.SLICE + 6)}") for i in rng.permutation(400)]
    labels = [(i, int(rng.integers(2)), int(rng.integers(2))) for i in range(0, 400, 3)]
    found = got(A.audit(A.contingency(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))))
    assert found == brute(docs, labels)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(A.contingency(docs, labels)).count() == 0
    some = spark.createDataFrame([(1, "one", "s")], "doc_id long, text string, source string")
    rows = got(A.audit(A.contingency(some, labels)))
    assert len(rows) == 600 and rows["s", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120]


@pytest.mark.parametrize("k", range(5))
def test_contractions_are_sums_over_cells(k):
    tensor = np.random.default_rng(k).integers(0, 99, (3, 2, 2, 2, 2, 2, 3))
    found = A.measures(tensor)
    sums = defaultdict(lambda: np.zeros(3, int))
    for at, step in enumerate(A.STEPS):
        order, place = step
        for bits in np.ndindex(2, 2, 2, 2, 2):
            early = any(bits[A.LETTERS.index(x)] for x in order[:place])
            own = bits[A.LETTERS.index(order[place])]
            cell = tensor[(slice(None), *bits, 0)]
            sums["removed", at] += cell * (own and not early)
            sums["redundant", at] += cell * (own and early)
            sums["kept", at] += cell * (not own and not early)
            sums["unique_fails", at] += cell * (own and sum(bits) == 1)
    for (name, at), want in sums.items():
        assert (found[name][:, at] == want).all()
