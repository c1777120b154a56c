"""Queries over generation metrics that match words by place, and over words of unspaced texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alignment as A
from ..functions import metrics as M
from ..functions import text as T
from ..operators import segment as G
from ..sources.tables import load
from .registry import query
from .reports import _ANSWERS, _SCORES, _WORDS, _pairs


@query()
def rouge_lsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary-level ROUGE-L of each answer, sentences ending at full stops, question and exclamation marks and line ends."""
    split = lambda c: A.sentences(F.col(c), T.ascii_tokens, r"[.!?\n]+")
    rows = _pairs(spark, sf_dir).select("key", split("answer").alias("a"), split("truth").alias("t"))
    return rows.select("key", F.round(A.rouge_lsum(F.col("a"), F.col("t")), 6).alias("rouge_lsum"))


@query()
def meteor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """METEOR of each answer by exact matches."""
    rows = _pairs(spark, sf_dir).select("key", T.ascii_tokens(F.col("answer")).alias("a"), T.ascii_tokens(F.col("truth")).alias("t"))
    return rows.select("key", F.round(A.meteor(F.col("a"), F.col("t")), 6).alias("meteor"))


@query(_ANSWERS + r"""w AS (SELECT key, list_filter(regexp_extract_all(lower(answer), '\S+'), lambda x: regexp_matches(x, '[a-z0-9一-鿿]')) AS a, list_filter(regexp_extract_all(lower(truth), '\S+'), lambda x: regexp_matches(x, '[a-z0-9一-鿿]')) AS t FROM p),
""" + _WORDS.split("\n", 1)[1] + _SCORES)
def word_f1_segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiset F1 of words by a dictionary learnt from the documents; where nothing is unspaced these are the words between spaces."""
    tokens = G.tokenizer(spark, G.learn(load(spark, sf_dir, "documents").select("text")))
    words = _pairs(spark, sf_dir).select("key", tokens(F.col("answer")).alias("a"), tokens(F.col("truth")).alias("t"))
    scored = M.multiset_scores(M.overlap_counts(words, "key", "a", "t"), "key")
    return scored.select("key", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "f1")])


@query()
def unspaced_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every turn of the conversations, found again after all that stands between their letters is taken away.

    The dictionary are the words of the documents; shares are those of the
    turn's own words that are found in it again.
    """
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")
    known = load(spark, sf_dir, "documents").select(words).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(G.MOST)
    own = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", own.alias("own")).withColumn("text", F.array_join("own", ""))
    found = G.segmented(turns, known, "[a-z]+", r"[^\sa-z]+")
    common = F.size(F.array_intersect("own", "words")) / F.greatest(F.size(F.array_distinct("own")), F.lit(1))
    return found.select("conv_id", "turn", F.array_join("words", " ").alias("words"), F.round(common, 6).alias("found"))
