"""Spelling variants against all pairs of words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quern.llm import spelling as S

SCHEMA = "doc_id long, text string, word string, n long, form string, root string"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, rarest=S.RAREST):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= rarest}
    by = {w: sorted((v for v in n if v != w and near(w, v)), key=lambda v: (-n[v], v)) for w in n}
    form = {w: vs[0] if vs and n[vs[0]] >= 2 * n[w] else None for w, vs in by.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(by[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def got(spark, rows, **how):
    df = spark.createDataFrame([(*r, "clash", 1, "x", "y") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in S.variants(df, **how).select("word", "form", "root", "n", "n_near", "form_n").collect()))


def noisy(seed, n, letters="abcdeéÀÿ"):
    """Texts of words that are a few letters away from each other."""
    rng = np.random.default_rng(seed)
    base = ["".join(rng.choice(list(letters), rng.integers(4, 9))) for _ in range(12)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(30):
            w = base[min(int(rng.exponential(3)), 11)]
            if rng.random() < 0.4:
                at = int(rng.integers(len(w) + 1))
                w = w[:at] + str(rng.choice(["", *letters])) + w[at + int(rng.integers(2)) :]
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_all_pairs(spark, seed):
    rows = noisy(seed, 150)
    want = brute(rows)
    assert got(spark, rows) == want
    assert len({w[2] for w in want}) < len(want) and max(w[4] for w in want) > 3


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = {tuple(r) for r in S.variants(docs).select("word", "n").collect()}
    assert found == {(w[0], w[3]) for w in brute_counts(rows)}


def brute_counts(rows):
    counts = Counter()
    for doc_id, text in rows:
        for word, n in S.words_of(str(doc_id), (text or "").encode()):
            counts[word] += n
    return [(w, None, None, n) for w, n in counts.items() if n >= S.RAREST]


def test_odd_rows(spark):
    long = "ab" * 3000
    rows = [
        (1, None), (2, ""), (None, "house house HOUSE"), (None, "house"), (3, "hause hause hause"), (3, "hause hause hause"), (4, "straße STRASSE Straße straße"), (5, "ÀÉÎ éé àéîõü àéîõü àéîõü ÀÉÎÕÜ"),
        (6, f"{long} {long} {long} {long}x {long}x {long}x {long[1:]} {long[1:]} {long[1:]}"), (7, "1house2house3"), (8, "Kelvin Kelvin Kelvin kelvin kelvin kelvin"), (9, "aaaaaa aaaaaa aaaaaa aaaaa aaaaa aaaaa"),
    ]
    assert got(spark, rows) == brute(rows)


def test_no_words(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None), (2, "a b c"), (3, "words seldom")]) == []


def test_full_filters_let_more_through_and_change_nothing(spark):
    words = spark.createDataFrame([(f"{'abcde'[i % 5]}{'fghij'[i // 5 % 5]}{'klmno'[i // 25]}xyz", i + 3) for i in range(125)], "word string, n long")
    pairs = lambda **how: sorted(map(tuple, S.near_pairs(words, **how).select("a", "b").collect()))
    full = S.build(words, bits=1, most=1)
    assert full.blocks.shape[0] == S.LENGTHS + 1 and S.build(words).blocks.shape[0] > full.blocks.shape[0]
    assert pairs() == pairs(bits=1, most=1)
    assert len(pairs()) == 125 * 12 // 2


def test_filters_know_all_they_hold_and_little_else():
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzéü"), 8)) for _ in range(20000)]
    held, others = sorted(set(words[:10000])), sorted(set(words[10000:]) - set(words[:10000]))
    filters = S.Filters({8: len(held)})
    block, bits = filters.places(S.hashes(S._letters(held)), 8)
    np.bitwise_or.at(filters.blocks, block, bits)
    assert filters.knows(S.hashes(S._letters(held)), 8).all()
    assert filters.knows(S.hashes(S._letters(others)), 8).mean() < 0.01
    assert not filters.knows(S.hashes(S._letters(["abcdefg"])), 7).any()


def test_roots_end_far_away(spark):
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(40)] + [("x", "w3")], "word string, root string")
    assert {tuple(r) for r in S.roots(chain).collect()} == {*((f"w{i}", "w40") for i in range(40)), ("x", "w40")}
