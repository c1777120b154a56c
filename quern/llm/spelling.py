"""Groups of spelling variants, found by probing Bloom filters with generated edits.

The words of a corpus are counted; each becomes a few hundred strings one edit
away, of which nearly all are no words. Blocked Bloom filters, one shard for
each word length, say so where the strings are made: the filters are
broadcast, with MOST_BLOCKS as the bound of their size whatever the vocabulary
holds. Only strings that a filter knows are shuffled, to a join with the
vocabulary itself that removes false positives. A fuller filter lets more of
those through, and costs time and not results.

Of two words that differ in a letter, the one with the larger letter there is
the one that probes; of a longer and a shorter word it is the longer one, at
the last of equal letters. So each near pair is met exactly once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents

RUN = re.compile("[A-Za-zÀ-ÿ]+")
DROP, SHORTEST, RAREST, TIMES = 97, 5, 3, 2
#: Filters: bits for a word while there is room, blocks of 512 bits at most (64 MiB), lengths with a shard of their own.
BITS, MOST_BLOCKS, LENGTHS = 16, 1 << 20, 64
#: Words of one task, letters and probes handled at once, counts a worker holds, characters of a text read as one list.
WORDS, CHUNK, PROBES, HELD, LONG = 8192, 1 << 18, 1 << 17, 200_000, 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(doc_id: str, text: bytes) -> Iterator[tuple[str, int]]:
    """The words of one UTF-8 text with their counts, some of them with a letter dropped as the id and the word decide."""
    plain = text.translate(_LOWER).decode()
    runs = Counter(RUN.findall(plain) if len(plain) < LONG else (m[0] for m in RUN.finditer(plain)))
    start = zlib.crc32(f"{doc_id}:".encode())
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % DROP == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= SHORTEST:
            yield run, n


def vocabulary(docs: DataFrame, rarest: int = RAREST) -> DataFrame:
    """word, n: the words of all whole texts that occur at least `rarest` times.

    A null text has no words; a null doc_id counts as the empty string. Workers
    sum up before Spark does, and Spark before it shuffles, so that a word that
    stands everywhere is a few rows. Only doc_id and text are read.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                for word, n in words_of(doc_id, text):
                    held[word] += n
                if len(held) > HELD:
                    yield counts(held)
                    held.clear()
        yield counts(held)

    def counts(held: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    text = F.col("text").cast("string").cast("binary")
    rows = docs.where(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), text.alias("t"))
    return rows.mapInArrow(each, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= rarest)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: each bit of the result depends on all of `x`."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _weight(place: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """What a letter at a place adds (by exclusive or) to the hash of a word."""
    return _mix((place.astype(np.uint64) << np.uint64(7)) + letter.astype(np.uint64) + np.uint64(1))


def _letters(words: list[str]) -> np.ndarray:
    """Words of one length as numbers of their letters: a to z, then À to ÿ."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.int16)
    return np.where(codes < 123, codes - 97, codes - 0xC0 + 26)


def _letter(number: int) -> str:
    return chr(number + 97 if number < 26 else number - 26 + 0xC0)


class Filters:
    """Split-block Bloom filters over one array of blocks; `start` and `size` say where a length's shard lies."""

    def __init__(self, words: dict[int, int], bits: int = BITS, most: int = MOST_BLOCKS) -> None:
        """`words`: how many words each shard is to hold. All shards together take at most `most` blocks, and one each at least."""
        want = np.array([max(1, -(-words.get(s, 0) * bits // 512)) for s in range(LENGTHS + 1)], np.int64)
        if want.sum() > most:
            want = np.maximum(1, want * max(0, most - len(want)) // want.sum())
        self.size, self.start = want.astype(np.uint64), np.r_[0, np.cumsum(want)[:-1]].astype(np.uint64)
        self.blocks = np.zeros((int(want.sum()), 8), np.uint64)

    @staticmethod
    def shard(length: int) -> int:
        return min(length, LENGTHS)

    def places(self, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The block of each word of this length, and its bit in each of the block's eight parts."""
        s, h = self.shard(length), _mix(hashes ^ np.uint64(length))
        block = self.start[s] + (h >> np.uint64(20)) % self.size[s]
        bit = (_mix(h + np.uint64(1))[:, None] >> (np.arange(8, dtype=np.uint64) * np.uint64(6))) & np.uint64(63)
        return block.astype(np.int64), np.uint64(1) << bit

    def knows(self, hashes: np.ndarray, length: int) -> np.ndarray:
        out = np.zeros(len(hashes), bool)
        for at in range(0, len(hashes), PROBES):
            block, bits = self.places(hashes[at : at + PROBES], length)
            out[at : at + PROBES] = ((self.blocks[block] & bits) == bits).all(axis=1)
        return out


def _by_length(words: list[str]) -> Iterator[list[str]]:
    """Words of one length, in lists of about CHUNK letters at most."""
    groups: dict[int, list[str]] = {}
    for word in words:
        groups.setdefault(len(word), []).append(word)
    for length, group in groups.items():
        step = max(1, CHUNK // max(length, 1))
        for at in range(0, len(group), step):
            yield group[at : at + step]


def hashes(letters: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.reduce(_weight(np.arange(letters.shape[1])[None, :], letters), axis=1)


def edits(words: list[str], filters: Filters) -> Iterator[tuple[str, str]]:
    """(word, string) for the strings one deletion or one smaller letter away that the filters know; `words` are of one length."""
    c = _letters(words)
    length = c.shape[1]
    weights = _weight(np.arange(length)[None, :], c)
    whole = np.bitwise_xor.reduce(weights, axis=1)
    if length > SHORTEST:
        before = np.bitwise_xor.accumulate(weights, axis=1) ^ weights
        moved = _weight(np.arange(-1, length - 1).clip(0)[None, :], c)
        behind = np.bitwise_xor.accumulate(moved[:, ::-1], axis=1)[:, ::-1] ^ moved
        last = np.ones(c.shape, bool)
        last[:, :-1] = c[:, :-1] != c[:, 1:]
        i, at = np.nonzero(last)
        hit = filters.knows((before ^ behind)[i, at], length - 1)
        for k, a in zip(i[hit].tolist(), at[hit].tolist()):
            yield words[k], words[k][:a] + words[k][a + 1 :]
    flat, own = c.ravel(), weights.ravel()
    for start in range(0, len(flat), PROBES // 8):
        smaller = flat[start : start + PROBES // 8].astype(np.int64)
        of = np.repeat(np.arange(start, start + len(smaller)), smaller)
        new = np.arange(len(of)) - np.repeat(np.cumsum(smaller) - smaller, smaller)
        hit = filters.knows(whole[of // length] ^ own[of] ^ _weight(of % length, new), length)
        for k, x in zip(of[hit].tolist(), new[hit].tolist()):
            word, a = words[k // length], k % length
            yield word, word[:a] + _letter(x) + word[a + 1 :]


def build(words: DataFrame, bits: int = BITS, most: int = MOST_BLOCKS) -> Filters:
    """The filters of a vocabulary. Tasks set bits, Spark joins them by block; at most `most` blocks reach the driver."""
    shard = F.least(F.length("word"), F.lit(LENGTHS))
    filters = Filters({r["s"]: r["n"] for r in words.groupBy(shard.alias("s")).agg(F.count("*").alias("n")).collect()}, bits, most)
    parts = [f"p{i}" for i in range(8)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in _by_length(batch.column(0).to_pylist()):
                block, bit = empty.places(hashes(_letters(group)), len(group[0]))
                yield pa.RecordBatch.from_arrays([pa.array(block), *[pa.array(b.view(np.int64)) for b in np.ascontiguousarray(bit.T)]], ["block", *parts])

    empty = Filters.__new__(Filters)
    empty.size, empty.start = filters.size, filters.start  # where the shards lie, without their blocks
    rows = words.select("word").mapInArrow(each, ", ".join(f"{c} long" for c in ("block", *parts)))
    found = rows.groupBy("block").agg(*[F.expr(f"bit_or({p})").alias(p) for p in parts]).toArrow()
    if found.num_rows:
        filters.blocks[found.column("block").to_numpy()] = np.stack([found.column(p).to_numpy().view(np.uint64) for p in parts], axis=1)
    return filters


def near_pairs(words: DataFrame, bits: int = BITS, most: int = MOST_BLOCKS) -> DataFrame:
    """a, a_n, b, b_n: each pair of words (word, n) one edit apart, once. `words` are distinct."""
    spark = words.sparkSession
    filters = spark.sparkContext.broadcast(build(words, bits, most))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = dict(zip(*(c.to_pylist() for c in batch.columns)))
            for group in _by_length(list(n)):
                found = list(edits(group, filters.value))
                if found:
                    a, b = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array([n[w] for w in a], pa.int64()), pa.array(b)], ["a", "a_n", "b"])

    dealt = words.select("word", "n").repartition(max(1, -(-words.count() // WORDS)), "word")
    positives = dealt.mapInArrow(probe, "a string, a_n long, b string")
    return positives.join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b").select("a", "a_n", "b", "b_n")


def variants(docs: DataFrame, rarest: int = RAREST, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n: a row for each word of the corpus.

    form is the near word of largest n (ties: the smallest by code points) if
    that is at least `times` n, else null with form_n; root is where the forms
    lead, the word itself if it has none. Repeated rows count again; an empty
    table, or one of null and empty texts, gives no rows. Texts and words of
    any length are whole.
    """
    words = cut(vocabulary(docs, rarest))
    pairs = cut(near_pairs(words))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    best = F.min(F.struct((-F.col("b_n")).alias("neg"), F.col("b").alias("form")))
    near = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best.alias("best"))
    led = F.col("best.neg") <= -times * F.col("n")
    rows = cut(
        words.join(near, "word", "left").select(
            "word", F.when(led, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(led, -F.col("best.neg")).alias("form_n")
        )
    )
    return rows.join(roots(rows.where("form is not null").select("word", F.col("form").alias("root"))), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def roots(steps: DataFrame, rounds: int = 64) -> DataFrame:
    """word, root: `steps` followed to the end, twice as far in each round.

    As counts grow along the forms there is no way back to a word, and as they
    double, no way is longer than 63 steps, which six rounds cover.
    """
    for _ in range(rounds):
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = cut(steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not steps.agg(F.coalesce(F.max("moved"), F.lit(False))).first()[0]:
            return steps.drop("moved")
        steps = steps.drop("moved")
    raise RuntimeError("forms lead in a circle")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir))


SQL = r"""WITH RECURSIVE t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
c AS (SELECT run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM r GROUP BY doc_id, run),
h AS (SELECT run, n, xor(list_reduce(range(0, length(x) // 2), lambda c, k: xor(c >> 8, t[(xor(c, ('0x' || substr(x, 2 * k + 1, 2))::BIGINT) & 255) + 1]), 4294967295), 4294967295) AS h FROM c, t),
e AS (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM e WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
k AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
d AS (SELECT DISTINCT k.word AS long, k.n AS long_n, w.word AS short, w.n AS short_n FROM k JOIN w ON w.word = k.a || k.b),
p AS MATERIALIZED (SELECT x.word, x.n, y.word AS near, y.n AS near_n FROM k x JOIN k y ON y.a = x.a AND y.b = x.b AND y.word <> x.word
  UNION ALL SELECT long, long_n, short, short_n FROM d UNION ALL SELECT short, short_n, long, long_n FROM d),
b AS MATERIALIZED (SELECT w.word, w.n, coalesce(q.n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
  FROM w LEFT JOIN (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near FROM p QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1) q ON q.word = w.word),
f AS (SELECT word, word AS root, form AS next FROM b UNION ALL SELECT f.word, b.word, b.form FROM f JOIN b ON b.word = f.next)
SELECT b.word, form, root, n, n_near, form_n FROM b JOIN f ON f.word = b.word AND f.next IS NULL"""
