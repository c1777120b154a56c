"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints of 64 bits link at RADIUS or fewer differing bits. The bits are
dealt to the nonzero vectors of {0,1}^(RADIUS+1); each nonzero mask vector v
keeps the bits whose vector has an odd product with v. The vectors of the at
most RADIUS differing bits of a linked pair span less than the whole space,
so some v is orthogonal to all of them: in the table of that mask the pair
agrees on every kept bit. With RADIUS 2 these are 7 tables of 36 or 37 kept
bits, and no linked pair is missed.

Within a table, fingerprints with equal kept bits are a bucket. Buckets of at
most SMALL members are joined pair by pair and verified. In larger ones each
member is tied to the fingerprints one flipped free bit away (and to itself):
two members within two bits share such a midpoint and members further apart
share none, so the components are exactly those of the links while the rows
grow with the members, not with their pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents
from .graph import components

BITS, RADIUS, SHINGLE, SMALL = 64, 2, 3, 32


def masks(bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """The covering masks, as unsigned integers."""
    space = 2 ** (radius + 1)
    vectors = [1 + i % (space - 1) for i in range(bits)]
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, space)]


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text: a bit is set if over half the shingles' XXH64 values have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    hashed = xxhash.xxh64_intdigest
    h = np.fromiter(
        (hashed(joined[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())),
        np.uint64,
        len(words) - k + 1,
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        block = h[at : at + (1 << 16)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def _hashes() -> list[Column]:
    """128 bits that stand for a row's text."""
    text = F.col("text").cast("string")
    return [F.xxhash64(text).alias("__h1"), F.xxhash64(F.lit(1), text).alias("__h2")]


def fingerprints(docs: DataFrame, hashes: bool = False) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long), a row for each row of `docs`; with `hashes` also __h1 and __h2.

    A null or empty text has fingerprint 0. Only doc_id and text are read, so
    further columns, whatever their names, do no harm.
    """
    names = ["doc_id", "fp", *["__h1", "__h2"] * hashes]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint_of(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]], names)

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *_hashes() * hashes
    )
    return rows.mapInArrow(each, ", ".join(f"{n} long" for n in names))


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) over fingerprints whose components are those of the links.

    `fps` holds distinct fingerprints in column fp. b may be a midpoint that no
    text has; it lies between two that are linked through it.
    """
    keyed = fps.select(
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks()])).alias("mask", "key"),
    )
    shared = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
    member = cut(keyed.join(shared, ["mask", "key"]))
    few = member.where(F.col("n") <= SMALL)
    pairs = (
        few.alias("x")
        .join(few.alias("y"), ["mask", "key"])
        .where("x.fp < y.fp and bit_count(x.fp ^ y.fp) <= " + str(RADIUS))
        .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    )
    free = [F.array(*[F.lit(_signed(1 << i)) for i in range(BITS) if not m >> i & 1]) for m in masks()]
    flip = F.explode(F.element_at(F.array(*free), F.col("mask") + 1)).alias("flip")
    middle = member.where(F.col("n") > SMALL).select("fp", flip).select(
        F.col("fp").alias("a"), F.col("fp").bitwiseXOR(F.col("flip")).alias("b")
    )
    return pairs.unionByName(_shared_midpoints(middle)).distinct()


def _shared_midpoints(middle: DataFrame) -> DataFrame:
    """Only midpoints that two members touch, or that are themselves members, tie anything together."""
    middle = middle.distinct()
    touched = middle.groupBy("b").agg(F.count("*").alias("n")).where("n > 1").select("b")
    member = middle.select(F.col("a").alias("b")).distinct()
    return middle.join(touched.unionByName(member).distinct(), "b", "left_semi").select("a", "b")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _grouped(docs: DataFrame, hashes: bool = False) -> DataFrame:
    """The rows of fingerprints() with their group: component (one for each) and component_id (its smallest doc_id)."""
    rows = cut(fingerprints(docs, hashes))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(distinct.select("fp")))
    grouped = distinct.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")
    )
    least = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = grouped.join(least, "component").select("fp", "component", "component_id")
    return rows.join(classes, "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: a row for each row of `docs`.

    component_id is the smallest doc_id whose text is reachable over links of
    two or fewer bits. Repeated rows and rows of equal fingerprint share a
    component; a null doc_id is never the smallest unless all are null. Texts
    without words have fingerprint zero and link like any other.
    """
    return _grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of `docs` for each group of near-duplicates.

    It is the one with the smallest doc_id; of several with that doc_id the
    least by text, source and the other columns by name. Rows without doc_id
    are kept only where no row of their group has one. A doc_id on texts of
    several groups can stand for each of them.
    """
    keep = (
        _grouped(docs, hashes=True)
        .where("doc_id <=> component_id")
        .select(F.col("doc_id").alias("__keep"), "__h1", "__h2", F.col("component").alias("__group"))
        .distinct()
        .withColumnsRenamed({"__h1": "__k1", "__h2": "__k2"})
    )
    h1, h2 = _hashes()
    same = F.col("doc_id").eqNullSafe(F.col("__keep")) & (F.col("__h1") == F.col("__k1")) & (F.col("__h2") == F.col("__k2"))
    kept = docs.select("*", h1, h2).join(keep, same)
    ordered = [f.name for f in docs.schema if not re.search("map|variant|interval", f.dataType.simpleString())]
    least = F.min_by(F.struct(*docs.columns), F.struct(*sorted(ordered, key=lambda c: (c != "text", c != "source", c))))
    return kept.groupBy("__group").agg(least.alias("row")).select("row.*")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
