"""Retrieval and generation metrics as column expressions and grouped joins."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .vectors import char_set


def _list(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def hit(retrieved: Column, truth: Column) -> Column:
    """1 if any truth id was retrieved; an empty truth is 0."""
    return F.when(F.size(F.array_intersect(_list(retrieved), _list(truth))) > 0, 1.0).otherwise(0.0)


def reciprocal_rank(retrieved: Column, truth: Column) -> Column:
    """One over the place of the first relevant id."""
    r = _list(retrieved)
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(r), F.lit(1))), lambda i: F.array_contains(_list(truth), F.try_element_at(r, i)))
    return F.coalesce(1.0 / F.try_element_at(places, F.lit(1)), F.lit(0.0))


def recall(retrieved: Column, truth: Column) -> Column:
    """Common ids over the length of the truth list, repeats included."""
    r, t = _list(retrieved), _list(truth)
    return F.when((F.size(r) > 0) & (F.size(t) > 0), F.size(F.array_intersect(r, t)) / F.size(t)).otherwise(0.0)


def precision(retrieved: Column, truth: Column) -> Column:
    r, t = _list(retrieved), _list(truth)
    return F.when((F.size(r) > 0) & (F.size(t) > 0), F.size(F.array_intersect(r, t)) / F.size(r)).otherwise(0.0)


def harmonic(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def f1(retrieved: Column, truth: Column) -> Column:
    return harmonic(precision(retrieved, truth), recall(retrieved, truth))


def char_recall(answer: Column, truth: Column) -> Column:
    """Of character sets; 0 where either is empty."""
    a, t = char_set(answer), char_set(truth)
    return F.when((F.size(a) > 0) & (F.size(t) > 0), F.size(F.array_intersect(a, t)) / F.size(t)).otherwise(0.0)


def char_precision(answer: Column, truth: Column) -> Column:
    a, t = char_set(answer), char_set(truth)
    return F.when((F.size(a) > 0) & (F.size(t) > 0), F.size(F.array_intersect(a, t)) / F.size(a)).otherwise(0.0)


def char_f1(answer: Column, truth: Column) -> Column:
    return harmonic(char_precision(answer, truth), char_recall(answer, truth))


_METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "hit": hit, "mrr": reciprocal_rank, "recall": recall, "precision": precision, "f1": f1,
    "char_recall": char_recall, "char_precision": char_precision, "char_f1": char_f1,
}


def register(name: str, metric: Callable[[Column, Column], Column]) -> None:
    if not callable(metric):
        raise TypeError("a metric is a function of two columns")
    _METRICS[name] = metric


def metric(name: str) -> Callable[[Column, Column], Column]:
    return _METRICS[name]


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of `n` tokens, space-joined."""
    last = F.size(tokens) - n + 1
    places = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))


def overlap_counts(pairs: DataFrame, key: str, answer: str, truth: str) -> DataFrame:
    """key, n_answer, n_truth and common (multiset overlap) of two array columns.

    Counts are summed up for each key and token before they meet, so that long
    answers cost rows and not nested loops.
    """
    rows = (
        pairs.select(key, F.explode(answer).alias("token"), F.lit(1).alias("a"), F.lit(0).alias("t"))
        .unionByName(pairs.select(key, F.explode(truth).alias("token"), F.lit(0).alias("a"), F.lit(1).alias("t")))
        .groupBy(key, "token")
        .agg(F.sum("a").alias("a"), F.sum("t").alias("t"))
        .groupBy(key)
        .agg(F.sum("a").alias("n_answer"), F.sum("t").alias("n_truth"), F.sum(F.least("a", "t")).alias("common"))
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return pairs.select(key).join(rows, key, "left").select(key, zero("n_answer"), zero("n_truth"), zero("common"))


@F.pandas_udf(ArrayType(IntegerType()))
def common_grams(a: pd.Series, t: pd.Series) -> pd.Series:
    """How many runs of one, two, three and four tokens two arrays share, repeats included; each run is looked up once."""

    def one(x, y) -> list[int]:
        x, y = ([] if v is None else list(v) for v in (x, y))
        grams = lambda tokens, n: Counter(zip(*(tokens[i:] for i in range(n))))
        return [(grams(x, n) & grams(y, n)).total() for n in (1, 2, 3, 4)]

    return pd.Series([one(x, y) for x, y in zip(a, t)], dtype=object)


def multiset_scores(counts: DataFrame, key: str, both_empty: float = 1.0) -> DataFrame:
    """Recall, precision and F1 of overlap counts; two empty sides give `both_empty`, one gives 0."""
    r = F.when(F.col("n_truth") > 0, F.col("common") / F.col("n_truth")).otherwise(0.0)
    p = F.when(F.col("n_answer") > 0, F.col("common") / F.col("n_answer")).otherwise(0.0)
    empty = (F.col("n_truth") == 0) & (F.col("n_answer") == 0)
    pick = lambda c: F.when(empty, F.lit(both_empty)).otherwise(c)
    return counts.select(key, pick(r).alias("recall"), pick(p).alias("precision"), pick(harmonic(p, r)).alias("f1"))


@F.pandas_udf(IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """The length of the longest common subsequence of two arrays, a row of the usual table at a time, as bits."""

    def one(x, y) -> int:
        x, y = ([] if v is None else v for v in (x, y))
        at: dict[str, int] = {}
        for i, word in enumerate(x):
            at[word] = at.get(word, 0) | 1 << i
        whole = (1 << len(x)) - 1
        row = whole
        for word in y:
            same = row & at.get(word, 0)
            row = ((row + same) | (row - same)) & whole
        return len(x) - row.bit_count()

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="int32")


def rouge_l(answer: Column, truth: Column) -> Column:
    n = lcs_length(answer, truth)
    p = F.when(F.size(answer) > 0, n / F.size(answer)).otherwise(0.0)
    r = F.when(F.size(truth) > 0, n / F.size(truth)).otherwise(0.0)
    return harmonic(p, r)


def bleu(counts: list[tuple[Column, Column]], n_answer: Column, n_truth: Column) -> Column:
    """BLEU of (matched, possible) n-gram counts with add-one smoothing above unigrams, and the brevity penalty."""
    logs = []
    for n, (matched, possible) in enumerate(counts, 1):
        extra = 0.0 if n == 1 else 1.0
        share = F.when(possible + extra > 0, (matched + extra) / (possible + extra)).otherwise(0.0)
        logs.append(F.when(share > 0, F.ln(share)))
    total = sum(logs[1:], logs[0]) / len(logs)
    penalty = F.when(n_answer >= n_truth, 1.0).otherwise(F.exp(1 - n_truth / F.greatest(n_answer, F.lit(1))))
    return F.when(n_answer > 0, F.coalesce(penalty * F.exp(total), F.lit(0.0))).otherwise(0.0)


def key_fact_scores(fact_found: Column, claim_supported: Column) -> Column:
    """Recall over facts, precision over claims (0 without claims) and F1; nulls without facts."""
    share = lambda a: F.size(F.filter(a, lambda b: b)) / F.size(a)
    some = F.size(fact_found) > 0
    r = F.when(some, share(fact_found))
    p = F.when(some, F.when(F.size(claim_supported) > 0, share(claim_supported)).otherwise(0.0))
    return F.struct(
        r.alias("recall"), p.alias("precision"), F.when(some, harmonic(p, r)).alias("f1"),
        F.size(fact_found).alias("n_facts"), F.when(some, F.size(claim_supported)).alias("n_claims"),
    )


#: The shares of entities and relations in the budget, by mode.
SHARES = {"local": (0.35, 0.45), "global": (0.35, 0.45), "hybrid": (0.25, 0.35), "mix": (0.15, 0.25), "naive": (0.15, 0.25)}


def token_budget(mean_tokens: Column, mode: Column) -> Column:
    """Base, target and the parts of a token budget for a retrieval mode."""
    base = mean_tokens.cast("int")
    target = (base * F.lit(1.1)).cast("int")

    def share(k: int) -> Column:
        out = F.lit(0.0)
        for name, shares in SHARES.items():
            out = F.when(mode == name, shares[k]).otherwise(out)
        return (target * out).cast("int")

    entity, relation = share(0), share(1)
    rest = F.floor((target - entity - relation) / 200).cast("int")
    return F.struct(
        base.alias("base"), target.alias("target"), entity.alias("max_entity_tokens"), relation.alias("max_relation_tokens"),
        F.greatest(F.lit(1), F.least(F.lit(20), rest)).alias("chunk_top_k"),
        F.greatest(F.lit(1), F.floor(target / 500).cast("int")).alias("vector_top_k"),
    )
