"""Words of texts that are written without spaces: a dictionary learnt from a corpus, and the likeliest way through its lattice."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut

#: What is written without spaces, by default: Chinese characters.
RUN = "[一-鿿]+"
#: The longest word, how often a word has to be seen, how much more often than its parts meet by chance (as a logarithm), and the most words of a dictionary.
LONGEST, LEAST, COHESION, MOST = 4, 3, 2.0, 200_000


class Segmenter:
    """A unigram dictionary: words with their counts. Characters that it lacks are words of half a count."""

    def __init__(self, counts: dict[str, int], run: str = RUN, rest: str = r"[^\s一-鿿]+") -> None:
        self.total = math.log(max(1, sum(counts.values())))
        self.cost = {w: self.total - math.log(n) for w, n in counts.items() if w and n > 0}
        self.unknown = self.total + math.log(2)
        self.longest = max(map(len, self.cost), default=1)
        self.parts = re.compile(f"({run})|({rest})")

    def words(self, run: str) -> list[str]:
        """The cheapest words of a run; of equally cheap ways the one whose last words are the longest."""
        best, back = [0.0], [0]
        for end in range(1, len(run) + 1):
            cost, begin = math.inf, end - 1
            for at in range(max(0, end - self.longest), end):
                word = run[at:end]
                own = self.cost.get(word, self.unknown if end - at == 1 else math.inf)
                if best[at] + own < cost - 1e-12:
                    cost, begin = best[at] + own, at
            best.append(cost)
            back.append(begin)
        out, at = [], len(run)
        while at:
            out.append(run[back[at] : at])
            at = back[at]
        return out[::-1]

    def tokens(self, text: str | None) -> list[str]:
        """Lower-case words: runs by the dictionary, all else by white space."""
        out: list[str] = []
        for m in self.parts.finditer((text or "").lower()):
            out += self.words(m[1]) if m[1] else [m[2]]
        return out


def grams(texts: DataFrame, run: str = RUN, longest: int = LONGEST) -> DataFrame:
    """gram, n: all strings of up to `longest` characters within the runs of `texts` (text), summed up before the shuffle."""
    runs = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(run), F.lit(0))).alias("r"))
    size = F.length("r")
    places = runs.select("r", F.explode(F.sequence(F.lit(1), size)).alias("at"), size.alias("size"))
    each = F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("size") - F.col("at") + 1))).alias("k")
    return places.select("r", "at", each).groupBy(F.substr("r", F.col("at"), F.col("k")).alias("gram")).agg(F.count("*").alias("n"))


def learn(texts: DataFrame, run: str = RUN, longest: int = LONGEST, least: int = LEAST, cohesion: float = COHESION, most: int = MOST, rounds: int = 2) -> DataFrame:
    """word, n: a dictionary of at most `most` words from `texts` (text).

    Strings seen `least` times or more are words if their parts, however they
    are split in two, meet by `cohesion` more often than chance has it. All
    characters are words. Then the corpus is segmented by what was found and
    the counts are taken from there, `rounds` times. Texts without runs, null
    ones or an empty table give an empty dictionary.
    """
    counted = cut(grams(texts, run, longest))
    total = float(counted.where(F.length("gram") == 1).agg(F.sum("n")).first()[0] or 1)
    size = F.length("gram")
    many = counted.where((size > 1) & (F.col("n") >= least))
    split = F.explode(F.sequence(F.lit(1), size - 1)).alias("k")
    halves = many.select("gram", "n", split).select("gram", "n", F.substr("gram", F.lit(1), F.col("k")).alias("a"), F.substr("gram", F.col("k") + 1, F.length("gram")).alias("b"))
    of = lambda c: counted.select(F.col("gram").alias(c), F.col("n").alias(f"n_{c}"))
    met = halves.join(of("a"), "a").join(of("b"), "b")
    held = met.groupBy("gram").agg(F.first("n").alias("n"), F.min(F.ln(F.col("n") * total / (F.col("n_a") * F.col("n_b")))).alias("c")).where(F.col("c") >= cohesion)
    words = held.select(F.col("gram").alias("word"), "n").unionByName(counted.where(size == 1).select(F.col("gram").alias("word"), "n"))
    for _ in range(rounds):
        words = cut(_fewer(words, most))
        found = segmented(texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(run), F.lit(0))).alias("text")), words, run)
        seen = found.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
        single = words.where(F.length("word") == 1).select("word", F.lit(0).alias("zero"))
        words = seen.join(single, "word", "full").where(F.col("zero").isNotNull() | (F.col("n") >= least)).select("word", F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)).alias("n"))
    return cut(_fewer(words, most))


def _fewer(words: DataFrame, most: int) -> DataFrame:
    return words.orderBy(F.desc("n"), "word").limit(most)


def segmenter(words: DataFrame, run: str = RUN, rest: str = r"[^\s一-鿿]+", most: int = MOST) -> Segmenter:
    """The dictionary (word, n) on the driver: it has `most` words at most, which is checked."""
    rows = words.select("word", "n").limit(most + 1).toArrow()
    if rows.num_rows > most:
        raise ValueError(f"a dictionary of more than {most} words")
    return Segmenter(dict(zip(rows.column("word").to_pylist(), rows.column("n").to_pylist())), run, rest)


def segmented(texts: DataFrame, words: DataFrame, run: str = RUN, rest: str = r"[^\s一-鿿]+") -> DataFrame:
    """The rows of `texts` with `words`, those of their text. A null text has none."""
    known = texts.sparkSession.sparkContext.broadcast(segmenter(words, run, rest))
    names, at = [*texts.columns, "words"], texts.columns.index("text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([known.value.tokens(t) for t in batch.column(at).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names)

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in texts.schema) + "words array<string>"
    return texts.mapInArrow(each, schema)


def tokenizer(spark, words: DataFrame, run: str = RUN) -> Callable[[Column], Column]:
    """A function from a text column to its words that hold a letter a-z, a digit or a character of a run, for the metrics that take tokens."""
    known = spark.sparkContext.broadcast(segmenter(words, run))
    telling = re.compile(f"[a-z0-9]|{run}")

    @F.pandas_udf("array<string>")
    def tokens(text: pd.Series) -> pd.Series:
        return pd.Series([[w for w in known.value.tokens(t) if telling.search(w)] for t in text])

    return tokens
