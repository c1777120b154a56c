"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text is the weighted set of its words, weighted by their counts. For each of
SAMPLES draws every word k has a rate r_k and a level c_k from Gamma(2, 1) and
a phase b_k from [0, 1), all hashed from the word and the draw. With weight S,
t = floor(ln S / r + b) and ln a = ln c - r (t - b + 1); the draw is (k, t) of
the smallest a. Two texts get the same draw with a probability equal to their
generalised Jaccard similarity, sum of minima over sum of maxima, so the share
of equal draws estimates it.

A text's neighbour in id order is found without a global sort: borders taken
from a sample of the keys cut the rows into blocks of about BLOCK rows (or
more, where that would be more than BORDERS blocks); a key is an id, a hash of
the text and the row's place in the input, so that rows without id and
repeated ids are split like any others. A window orders each block, and the
last row of a block is joined to the first row of the next. The texts are
shuffled once, by block; counting words and taking minima happen where they
then lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents

SAMPLES, BLOCK = 32, 512
#: The most block borders, and the sampled keys for each of them.
BORDERS, PER_BORDER = 1 << 15, 8
_GAP = r"[\x20\x09-\x0D]+"
_NONE = (1 << 63) - 1


def draw(term: Column, log_weights: list[Column], i: int) -> list[Column]:
    """For each weight of `term`, the i-th draw's (a, sample) packed into a long that orders by a.

    The upper bits hold ln a in steps of 2^-24, the lower 32 tell (term, t) apart.
    """
    bits = lambda x, shift, n: F.shiftrightunsigned(x, shift).bitwiseAND(F.lit((1 << n) - 1).cast("long"))
    h = F.xxhash64(term, F.lit(i))
    g = F.xxhash64(h, F.lit(i))
    part = lambda x, shift, n: (bits(x, shift, n) + F.lit(0.5)) * F.lit(2.0**-n)
    r = -F.ln(part(h, 43, 21) * part(h, 22, 21))
    b = part(h, 1, 21)
    log_c = F.ln(-F.ln(part(g, 32, 32) * part(g, 0, 32)))
    out = []
    for log_weight in log_weights:
        t = F.floor(log_weight / r + b)
        log_a = F.greatest(log_c - r * (t - b + F.lit(1.0)), F.lit(-63.0))
        level = F.shiftleft(((log_a + F.lit(64.0)) * F.lit(float(1 << 24))).cast("long"), 32)
        out.append(level.bitwiseOR(bits(h.bitwiseXOR(t), 0, 32)))
    return out


def signatures(terms: DataFrame, keys: list[str], counts: list[str], samples: int = SAMPLES) -> DataFrame:
    """`keys`, and for each column of `counts` its signature: an array of `samples` ints, zeros for no words.

    `terms` holds a row for each key and term (long) with its counts, one of
    which may be 0; rows of term null only make sure that their key has a row.
    """
    logs = [F.ln(F.greatest(F.col(c), F.lit(1)).cast("double")) for c in counts]
    absent = [F.when(F.col(c) > 0, F.lit(0)).otherwise(F.lit(_NONE)).cast("long") for c in counts]
    named = terms.select(
        *keys, F.coalesce("term", F.lit(0)).alias("term"),
        *[x.alias(f"__log{j}") for j, x in enumerate(logs)], *[x.alias(f"__absent{j}") for j, x in enumerate(absent)],
    )
    each = []
    for i in range(samples):
        packed = draw(F.col("term"), [F.col(f"__log{j}") for j in range(len(counts))], i)
        each += [F.min(F.greatest(p, F.col(f"__absent{j}"))).alias(f"__{j}_{i}") for j, p in enumerate(packed)]
    low = lambda x: F.when(x == _NONE, F.lit(0)).otherwise(x.bitwiseAND(F.lit((1 << 32) - 1).cast("long")))
    return named.groupBy(*keys).agg(*each).select(
        *keys, *[F.array(*[low(F.col(f"__{j}_{i}")) for i in range(samples)]).alias(c) for j, c in enumerate(counts)]
    )


def words_lower(text: Column) -> Column:
    """Words between ASCII white space, with A-Z in lower case; '' among them where the text starts or ends with a gap."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.split(lower, _GAP)


def fingerprints(texts: DataFrame, key: str, text: str, samples: int = SAMPLES) -> DataFrame:
    """One row (key, fingerprint: array) for each distinct key of `texts`; null and empty texts get zeros.

    Rows that share a key count as one text. Terms are pre-aggregated before
    the shuffle.
    """
    rows = texts.select(F.col(key).alias("key"), F.explode(words_lower(F.concat(F.lit(" "), F.coalesce(F.col(text), F.lit(""))))).alias("w"))
    terms = rows.groupBy("key", F.when(F.col("w") != "", F.xxhash64("w")).alias("term")).agg(F.count(F.when(F.col("w") != "", 1)).alias("fingerprint"))
    return signatures(terms, ["key"], ["fingerprint"], samples)


def likeness(a: Column, b: Column) -> Column:
    """The share of equal draws of two signatures."""
    same = F.zip_with(a, b, lambda x, y: F.when(x == y, 1.0).otherwise(0.0))
    return F.aggregate(same, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def as_hex(signature: Column) -> Column:
    return F.lower(F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


_KEY = "struct<n:boolean,i:bigint,h:bigint,m:bigint>"


def keyed(docs: DataFrame) -> DataFrame:
    """text (null as '') and key, whose ascending order is that of descending ids, rows without id last."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # ~id turns the order round without overflow; the place tells repeated rows apart.
    return rows.select("text", F.struct(
        F.col("doc_id").isNull().alias("n"), F.bitwise_not(F.coalesce("doc_id", F.lit(0).cast("long"))).alias("i"),
        F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("m"),
    ).alias("key"))


def borders(rows: DataFrame, size: int = BLOCK, most: int = BORDERS, seed: int = 3) -> list[str]:
    """Keys, as JSON and in order, that cut `rows` (with key) into parts of about `size` rows, `most` of them at most.

    They come from a sample whose expected size is PER_BORDER times their
    number; they decide how even the parts are, and nothing else.
    """
    n = rows.count()
    parts = min(most, n // size)
    if parts < 2:
        return []
    share = min(1.0, parts * PER_BORDER / n)
    picked = rows.select("key").sample(share, seed)
    place = F.row_number().over(Window.orderBy("key"))  # over the sample alone
    cuts = picked.withColumn("place", place).where(F.col("place") % PER_BORDER == 0).select(F.to_json("key").alias("key"), "place")
    return [r["key"] for r in cuts.orderBy("place").limit(most).collect()]


def block_of(key: Column, cuts: list[str]) -> Column:
    """How many of the sorted `cuts` are at most `key`: found in three steps of about the cube root of their number."""
    if not cuts:
        return F.lit(0)
    w = 2
    while w**3 < len(cuts):
        w += 1
    level = lambda part: F.from_json(F.lit("[" + ",".join(part) + "]"), f"array<{_KEY}>")
    below = lambda part: F.size(F.filter(part, lambda x: x <= key))
    first = below(level(cuts[w * w - 1 :: w * w])) * w
    second = first + below(F.slice(level(cuts[w - 1 :: w]), first + 1, F.lit(w)))
    return second * w + below(F.slice(level(cuts), second * w + 1, F.lit(w)))


def following(placed: DataFrame, value: str, last: Column) -> DataFrame:
    """`placed` (block, place, ...) with over: for the last row of a block `value` of the next block's first row,
    for the last of all that of the first of all, and null for the others."""
    firsts = placed.where("place = 1").select(F.col("block").alias("__b"), F.col(value).alias("over"))
    # A row for each block: at most BORDERS + 1.
    ring = Window.orderBy("__b")
    blocks = placed.where("place = 1").select(F.col("block").alias("__b"))
    before = F.coalesce(F.lag("__b").over(ring), F.max("__b").over(Window.partitionBy()))
    ends = firsts.join(F.broadcast(blocks.select("__b", before.alias("__before"))), "__b")
    return placed.join(ends.drop("__b"), (F.col("block") == F.col("__before")) & last, "left").drop("__before")


def edited(docs: DataFrame) -> DataFrame:
    """block, place, doc_id, text, next (the next text by descending id, the first after the last) and edited.

    Rows of equal id go by the hash of their text, repeated rows follow each
    other, and a lone row follows itself. A null text counts as empty, a null
    id comes last.
    """
    rows = keyed(docs)
    order = Window.partitionBy("block").orderBy("key")
    cuts = borders(rows)
    # As many partitions as blocks: what a task's words take stays that of a few blocks, however many rows there are.
    dealt = rows.withColumn("block", block_of(F.col("key"), cuts)).repartition(len(cuts) + 1, "block")
    placed = dealt.select(
        "block", "key", "text", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("follower")
    )
    n = F.length("text")
    k = F.floor(n / 3).cast("int")
    return (
        following(placed, "text", F.col("follower").isNull())
        .select("block", "place", F.when(~F.col("key.n"), F.bitwise_not("key.i")).alias("doc_id"), "text", F.coalesce("follower", "over", F.lit("")).alias("next"))
        .withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.col("next"), F.lit(1), k)))
    )


def fingerprint_edits(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Each text's signature beside those of its edited form and of the next text.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next, a row for each row of `docs`.

    Null and empty texts have signatures of zeros, which are alike; further
    columns are not read; an empty table gives an empty one.
    """
    rows = edited(docs)
    n = F.length("text")
    kept = F.regexp_extract(F.substring(F.col("text"), F.lit(1), n - F.floor(n / 3).cast("int")), r"(?s)^(.*[\x20\x09-\x0D])", 1)
    # Words before the last gap that both forms share are counted once for both.
    parts = rows.withColumn("kept", kept).select(
        "block", "place",
        F.explode(F.array(
            F.struct(F.concat(F.lit(" "), "kept").alias("t"), F.lit(1).alias("o"), F.lit(1).alias("e")),
            F.struct(F.substr("text", F.length("kept") + 1).alias("t"), F.lit(1).alias("o"), F.lit(0).alias("e")),
            F.struct(F.substr("edited", F.length("kept") + 1).alias("t"), F.lit(0).alias("o"), F.lit(1).alias("e")),
        )).alias("p"),
    )
    words = parts.select("block", "place", "p.o", "p.e", F.explode(words_lower(F.col("p.t"))).alias("w"))
    real = F.col("w") != ""
    terms = words.groupBy("block", "place", F.when(real, F.xxhash64("w")).alias("term")).agg(
        F.sum(F.when(real, F.col("o")).otherwise(0)).alias("original"), F.sum(F.when(real, F.col("e")).otherwise(0)).alias("edited")
    )
    plain = rows.select("block", "place", "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    # Joined in one plan, both sides read the same shuffle of the texts.
    found = cut(signatures(terms, ["block", "place"], ["original", "edited"], samples).join(plain, ["block", "place"]))
    # The next text's signature: the same neighbours, over rows that are small by now.
    order = Window.partitionBy("block").orderBy("place")
    followed = following(found.withColumn("follower", F.lead("original").over(order)), "original", F.col("follower").isNull())
    return followed.select(
        "doc_id", "n_chars", "edited_sha256",
        as_hex(F.col("original")).alias("fingerprint"),
        as_hex(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("original"), F.col("edited")).alias("near_edited"),
        likeness(F.col("original"), F.coalesce("follower", "over")).alias("near_next"),
    )


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(documents(spark, sf_dir))
