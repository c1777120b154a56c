"""From raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the runner may
write it as Parquet and hand the reread rows to the next one. All stages but
the last return the columns of `documents`, whatever these are: columns beside
doc_id, text and source are carried along as they are, also where their names
are ones that the operators use. An empty table gives an empty one everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import mixing, packing, quality, secret_scan, simhash
from quern.llm.common import cut


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good.

    Null and empty texts are judged by what the network makes of no words; of
    repeated rows and of equal texts all stay or all go. Rows without doc_id
    are judged like any other and teach nothing.
    """
    return quality.reject(docs, quality.fit_on_labels(spark, docs, sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Of several rows with that id the least by text and further columns stays.
    Rows without id stay only in groups without any id. Texts without words,
    null ones included, are one group.
    """
    return simhash.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found in them replaced by a mark.

    Null texts stay null; n_chars is counted anew where a text changed. Ties
    and repeated rows are each treated by themselves, texts of any length whole.
    """
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often (0 to 2 times) as the target weights of the sources take it.

    Documents without words are not taken; a null source is a source of its
    own. Rows alike in id, source and size are told apart by their text, and
    whole repeated rows are interchangeable. Reruns agree.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of all documents, placed into sequences.

    A null or empty text is one piece of the end id; long ones are cut.
    Repeated rows give repeated pieces, each with a place of its own.
    """
    return packing.packed(docs)


STAGES = [
    ("quality_classifier", quality_filter),
    ("simhash_near_dedup", near_dedup),
    ("secret_scans", mask_secrets),
    ("mixing_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: No SQL for a trained classifier, token ids or a search; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; between stages the rows go through the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, cut(docs) if k else docs, sf_dir)
    return docs
