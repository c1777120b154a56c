"""Metrics that need to know which words of two texts match, and not only how many: ROUGE-Lsum and METEOR."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .metrics import harmonic

#: Alignments that METEOR's search looks at for one pair; the best met by then counts.
NODES = 5_000
#: METEOR's weight of recall in the mean, and its penalty's exponent and weight.
ALPHA, BETA, GAMMA = 0.9, 3.0, 0.5


def common_places(x: Sequence[str], y: Sequence[str]) -> set[int]:
    """The places in `x` of one longest common subsequence with `y`.

    Of several it is the one met from the ends backwards, where the last word
    of `x` is given up first unless that shortens it. The table of lengths is
    kept as bits, a row for each word of `y`: a bit is 0 where the length grows.
    """
    at: dict[str, int] = {}
    for i, word in enumerate(x):
        at[word] = at.get(word, 0) | 1 << i
    whole = (1 << len(x)) - 1
    rows = [whole]
    for word in y:
        same = rows[-1] & at.get(word, 0)
        rows.append(((rows[-1] + same) | (rows[-1] - same)) & whole)
    length = lambda i, j: i - (rows[j] & ((1 << i) - 1)).bit_count()
    out, i, j = set(), len(x), len(y)
    while i and j:
        if rows[j] >> (i - 1) & 1:
            i -= 1  # as long without the last word of x
        elif length(i, j) == length(i, j - 1):
            j -= 1
        else:
            out.add(i - 1)
            i, j = i - 1, j - 1
    return out


def union_hits(answer: Sequence[Sequence[str]], truth: Sequence[Sequence[str]]) -> int:
    """Words of the truth's sentences that lie in the union of their common subsequences with each sentence of the
    answer; a word counts no more often than either side has it."""
    have, need = Counter(w for s in answer for w in s), Counter(w for s in truth for w in s)
    hits = 0
    for sentence in truth:
        places = set().union(*(common_places(sentence, s) for s in answer)) if answer else set()
        for i in sorted(places):
            w = sentence[i]
            if have[w] and need[w]:
                have[w] -= 1
                need[w] -= 1
                hits += 1
    return hits


def _lists(v) -> list[list[str]]:
    return [] if v is None else [list(s) for s in v if s is not None]


@F.pandas_udf(IntegerType())
def _union_hits(answer: pd.Series, truth: pd.Series) -> pd.Series:
    return pd.Series([union_hits(_lists(a), _lists(t)) for a, t in zip(answer, truth)], dtype="int32")


def rouge_lsum(answer: Column, truth: Column) -> Column:
    """F of two lists of sentences, each a list of words: hits of the union over the words of either side; 0 where either has none."""
    hits = _union_hits(answer, truth)
    size = lambda c: F.aggregate(F.coalesce(c, F.array().cast("array<array<string>>")), F.lit(0), lambda s, x: s + F.coalesce(F.size(x), F.lit(0)))
    share = lambda c: F.when(size(c) > 0, hits / size(c)).otherwise(0.0)
    return harmonic(share(answer), share(truth))


def sentences(text: Column, tokens, end: str = r"\n") -> Column:
    """The words of each sentence of a text, which ends where `end` matches."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), end), tokens)


def longest_first(x: Sequence[str], y: Sequence[str]) -> int:
    """Chunks of a largest matching made of the longest common runs first: of equal ones the first in x, then in y."""
    free_x, free_y, chunks = [True] * len(x), [True] * len(y), 0
    while True:
        best, row = (0, 0, 0), [0] * (len(y) + 1)
        for i, word in enumerate(x):
            before, row = row, [0] * (len(y) + 1)
            if free_x[i]:
                for j, other in enumerate(y):
                    if free_y[j] and word == other:
                        row[j + 1] = before[j] + 1
                        if row[j + 1] > best[0]:
                            best = (row[j + 1], i, j)
        n, i, j = best
        if not n:
            return chunks
        chunks += 1
        for k in range(n):
            free_x[i - k] = free_y[j - k] = False


def matches_and_chunks(x: Sequence[str], y: Sequence[str], nodes: int = NODES) -> tuple[int, int]:
    """How many words of `x` and `y` can be matched, and the fewest runs (chunks) that such a matching has.

    Branch and bound from left to right over `x`: a word is matched to a free
    place of `y`, the one that goes on with a run first, or left out while the
    rest has enough of it. What runs of words `y` lacks bounds what is to come.
    It begins with longest_first() and ends after `nodes` steps, with the
    fewest chunks met; without that end it is exact.
    """
    need = Counter(x) & Counter(y)
    total = need.total()
    if not total:
        return 0, 0
    places: dict[str, list[int]] = {}
    for j, w in enumerate(y):
        places.setdefault(w, []).append(j)
    pairs = set(zip(y, y[1:]))
    in_x, spare = Counter(x), Counter()
    for w in in_x:
        spare[w] = in_x[w] - need[w]
    forced = [0] * (len(x) + 1)  # chunks that must begin from here on: words matched in any case that go on with nothing
    for i in range(len(x) - 1, -1, -1):
        alone = i == 0 or (x[i - 1], x[i]) not in pairs
        forced[i] = forced[i + 1] + (need[x[i]] > 0 and not spare[x[i]] and alone)
    best, spent = longest_first(x, y), 0
    used = [False] * len(y)
    skipped: Counter[str] = Counter()

    def options(i: int, last: int):
        w = x[i]
        if need[w]:
            own = places[w]
            if last >= 0 and last + 1 < len(y) and y[last + 1] == w and not used[last + 1]:
                yield last + 1, 0
            for j in own:
                if not used[j] and not (last >= 0 and j == last + 1):
                    yield j, 1
        if skipped[w] < spare[w]:
            yield -1, 0

    # An explicit stack, as texts may be longer than Python's own.
    stack = [(0, 0, options(0, -1), None)]
    while stack:
        i, chunks, choice, taken = stack[-1]
        step = next(choice, None) if spent < nodes and best > forced[0] else None
        if step is None:
            stack.pop()
            if taken is not None:
                if taken >= 0:
                    used[taken] = False
                else:
                    skipped[x[i - 1]] -= 1
            continue
        spent += 1
        j, new = step
        if chunks + new + forced[i + 1] >= best:
            continue
        if i + 1 == len(x):
            best = chunks + new
            continue
        if j >= 0:
            used[j] = True
        else:
            skipped[x[i]] += 1
        stack.append((i + 1, chunks + new, options(i + 1, j), j))
    return total, best


@F.pandas_udf(StructType([StructField("matches", IntegerType()), StructField("chunks", IntegerType())]))
def alignment(answer: pd.Series, truth: pd.Series) -> pd.DataFrame:
    found = [matches_and_chunks([] if a is None else list(a), [] if t is None else list(t)) for a, t in zip(answer, truth)]
    return pd.DataFrame(found, columns=["matches", "chunks"]).astype("int32")


def meteor(answer: Column, truth: Column) -> Column:
    """METEOR of two lists of words by exact matches alone, as there are no tables of stems or synonyms.

    Recall counts nine times as much as precision, and matches in many short
    runs cost up to half of the score; 0 without a match.
    """
    found = alignment(answer, truth)
    m, chunks = found["matches"], found["chunks"]
    p, r = m / F.size(answer), m / F.size(truth)
    mean = p * r / (ALPHA * p + (1 - ALPHA) * r)
    return F.when(m > 0, mean * (1 - GAMMA * F.pow(chunks / m, F.lit(BETA)))).otherwise(0.0)
