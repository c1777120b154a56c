"""Lexical, dense and hybrid retrieval, reranking, context assembly and cut-offs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import jaccard, ranked
from .lineage import cut
from .sizes import CARRIED, bytes_of, carried

K1, B = 1.5, 0.75


#: The most terms that are looked up where the texts lie; more are shuffled.
WITHIN = 200_000


def spread(df: DataFrame) -> DataFrame:
    """`df`, dealt to all cores if its files give fewer parts than there are cores; a large table has more of them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = df.inputFiles()
    return df.repartition(cores) if len(files) < cores and df.rdd.getNumPartitions() <= cores else df


def _found_within(words: DataFrame, terms: pa.Array) -> DataFrame:
    """id, term, tf and n of the asked terms in each text, and a row of null term for each text; nothing is shuffled."""
    known = words.sparkSession.sparkContext.broadcast(terms)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, listed = batch.columns
            sizes = pc.fill_null(pc.list_value_length(listed), 0).to_numpy().astype(np.int64)
            code = pc.fill_null(pc.index_in(listed.flatten(), value_set=known.value), -1).to_numpy()
            key = np.repeat(np.arange(len(sizes)), sizes)[code >= 0] * len(known.value) + code[code >= 0]
            found, tf = np.unique(key, return_counts=True)
            row = np.r_[found // max(1, len(known.value)), np.arange(len(sizes))]
            term = pa.concat_arrays([known.value.take(pa.array(found % max(1, len(known.value)))), pa.nulls(len(sizes), pa.string())])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), term, pa.array(np.r_[tf, np.zeros(len(sizes), np.int64)].astype(np.int64)), pa.array(sizes[row].astype(np.int32))], ["id", "term", "tf", "n"])

    kind = words.schema["id"].dataType.simpleString()
    return words.select("id", "words").mapInArrow(each, f"id {kind}, term string, tf long, n int")


def bm25(corpus: DataFrame, queries: DataFrame, tokens=T.ascii_tokens, per_query: bool = False, k1: float = K1, b: float = B, within: int = WITHIN) -> DataFrame:
    """BM25 scores (qid, id, score) of `corpus` (id, text) for `queries` (qid, text).

    Only texts that share a term with a query get a row. The corpus is read
    and tokenized once. Up to `within` distinct terms of the queries are looked
    up in each text where it lies; more of them meet the corpus's words in a
    join. One more row for each text carries its length; all frequencies and
    totals are sums over what is left. With `per_query`, `corpus` has a qid and
    each query is scored within its own candidates. Ids are unique; null texts are empty ones.
    """
    own = ["qid"] if per_query else []
    terms = cut(queries.select("qid", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")))
    distinct = terms.select("term").distinct()
    words = (corpus if per_query else spread(corpus)).select(*own, "id", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("words"))
    if not per_query and distinct.limit(within + 1).count() <= within and bytes_of(distinct) <= CARRIED:
        tf = cut(_found_within(words, distinct.toArrow().column("term").combine_chunks().cast(pa.string())))
    else:
        asked = (terms if per_query else distinct).withColumn("asked", F.lit(True))
        posted = words.select(*own, "id", F.size("words").alias("n"), F.explode(F.array_append("words", F.lit(None).cast("string"))).alias("term"))
        met = posted.join(carried(asked), [*own, "term"], "left").where("asked or term is null")
        tf = cut(met.groupBy(*own, "id", "term").agg(F.count("*").alias("tf"), F.first("n").alias("n")))
    totals = tf.where("term is null").groupBy(*own).agg(F.count("*").alias("docs"), (F.sum("n") / F.greatest(F.count("*"), F.lit(1))).alias("avgdl"))
    tf = tf.where("term is not null").withColumn("dl", F.greatest("n", F.lit(1)))
    df = tf.groupBy(*own, "term").agg(F.count("*").alias("df"))
    hits = tf.join(df, [*own, "term"])
    hits = hits.join(totals, "qid") if per_query else hits.crossJoin(F.broadcast(totals))  # a single row
    idf = F.log1p((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rest = k1 * (1 - b + b * F.col("dl") / F.greatest(F.col("avgdl"), F.lit(1e-9)))
    part = idf * F.col("tf") * (k1 + 1) / F.greatest(F.col("tf") + rest, F.lit(1e-9))
    scored = hits.select(*own, "id", "term", part.alias("part"))
    found = scored if per_query else scored.join(terms, "term")
    return found.groupBy("qid", "id").agg(F.sum("part").alias("score"))


def top(scores: DataFrame, k: int, by: str = "qid", item: str = "id") -> DataFrame:
    """The `k` best of each query with rank; scores equal to nine places go by item."""
    return ranked(scores, by, [F.round("score", 9).desc(), F.col(item)], k)


def fuse(lists: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (qid, id, rank): qid, id, score, rank."""
    union = lists[0].select("qid", "id", "rank")
    for more in lists[1:]:
        union = union.unionByName(more.select("qid", "id", "rank"))
    return top(union.groupBy("qid", "id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score")), k)


def jaccard_rerank(found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """`found` (qid, id, rank, text) by the Jaccard similarity of white-space tokens; ties keep their order."""
    split = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.col(c)), r"\s+"), lambda w: w != ""))
    asked = queries.select("qid", split("text").alias("q"))
    scored = found.select("qid", "id", F.col("rank").alias("place"), split("text").alias("d")).join(asked, "qid").select("qid", "id", "place", jaccard(F.col("q"), F.col("d")).alias("score"))
    return ranked(scored, "qid", [F.round("score", 9).desc(), F.col("place")], k)


def round_robin(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """Two ranked lists (qid, name, rank) in turn, blank and repeated names dropped: qid, name, source, rank."""
    union = first.select("qid", "name", "rank", F.lit(0).alias("s")).unionByName(second.select("qid", "name", "rank", F.lit(1).alias("s")))
    kept = union.where(F.trim("name") != "").groupBy("qid", "name").agg(F.min(F.struct("rank", "s")).alias("m"))
    order = [F.col("m.rank"), F.col("m.s")]
    return ranked(kept, "qid", order, k).select("qid", "name", F.when(F.col("m.s") == 0, "local").otherwise("global").alias("source"), "rank")


def concatenate(lists: list[DataFrame], k: int, distinct: bool = False) -> DataFrame:
    """Ranked lists one after the other, cut to `k`; `distinct` keeps the first of repeated ids. qid, id, src, rank."""
    union = None
    for s, part in enumerate(lists):
        one = part.select("qid", "id", F.lit(s).alias("src"), F.col("rank").alias("place"))
        union = one if union is None else union.unionByName(one)
    if distinct:
        union = union.groupBy("qid", "id").agg(F.min(F.struct("src", "place")).alias("m")).select("qid", "id", "m.*")
    return ranked(union, "qid", [F.col("src"), F.col("place")], k).select("qid", "id", "src", "rank")


def cascade(lists: list[DataFrame], k: int, distinct: bool = False) -> DataFrame:
    """As `concatenate`, but a list is asked only while those before it gave fewer than `k`; the result is the same cut."""
    return concatenate(lists, k, distinct)


def first_seen(rows: DataFrame, value: str, order: str, group: str | None = None) -> DataFrame:
    """Order-preserving distinct: the first row of each value (within a group)."""
    keys = [value] if group is None else [group, value]
    rest = [c for c in rows.columns if c not in (*keys, order)]
    return rows.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("m")).select(*keys, "m.*")


def contexts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Context lines of a query: node descriptions, then edge descriptions, first segment of each, whole ones distinct."""
    union = nodes.select("qid", F.lit(0).alias("section"), "rank", "description").unionByName(edges.select("qid", F.lit(1).alias("section"), "rank", "description"))
    kept = union.where(F.trim("description") != "").groupBy("qid", "description").agg(F.min(F.struct("section", "rank")).alias("m"))
    line = T.first_segment(F.col("description"))
    return kept.select("qid", "m.section", "m.rank", line.alias("context"))


def running_sums(rows: DataFrame, group: str, order: str | list[str | Column], value: str) -> DataFrame:
    """`rows` (narrow: they are written once) with running, the sum of `value` up to each row of its group, and nth.

    The rows are dealt by ranges of (group, order); sums of earlier ranges are
    added to those within a range, so that a group of any size is spread.
    """
    by = [order] if isinstance(order, str) else order
    dealt = cut(rows.repartitionByRange(group, *by).withColumn("__part", F.spark_partition_id()))
    parts = dealt.groupBy(group, "__part").agg(F.sum(value).alias("s"), F.count("*").alias("c"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        F.col(group).alias("__g"), F.col("__part").alias("__p"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("__s"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("__c")
    )
    within = Window.partitionBy(group, "__part").orderBy(*by)
    summed = dealt.withColumn("__sum", F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__nth", F.row_number().over(within))
    met = summed.join(offsets, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p")))
    return met.withColumns({"running": F.col("__sum") + F.col("__s"), "nth": F.col("__nth") + F.col("__c")}).select(*rows.columns, "running", "nth")


def row_hashes(df: DataFrame) -> list[Column]:
    """__h1 and __h2: 128 bits that stand for a whole row."""
    columns = [F.col(f"`{f.name}`").cast("string") if re.search("map|variant", f.dataType.simpleString()) else F.col(f"`{f.name}`") for f in df.schema]
    return [F.xxhash64(*columns).alias("__h1"), F.xxhash64(F.lit(1), *columns).alias("__h2")]


def _counted(rows: DataFrame, group: str, order: str, text: str) -> DataFrame:
    narrow = rows.select(group, order, T.n_tokens(F.col(text)).alias("tokens"), *row_hashes(rows))
    return running_sums(narrow, group, [order, "__h1", "__h2"], "tokens")


def _kept(rows: DataFrame, keep: DataFrame, group: str, order: str) -> DataFrame:
    """A whole row for each of `keep`, found by its hashes; these are few, and the texts of the others go nowhere.

    Rows alike in all columns are one on the way and come out as often as `keep` has them.
    """
    keep = cut(keep.drop(group, order).withColumnsRenamed({"__h1": "__k1", "__h2": "__k2"}))
    same = (F.col("__h1") == F.col("__k1")) & (F.col("__h2") == F.col("__k2"))
    found = rows.select("*", *row_hashes(rows)).join(keep.select("__k1", "__k2").distinct(), same, "left_semi").dropDuplicates(["__h1", "__h2"])
    return found.join(keep, same).drop("__h1", "__h2", "__k1", "__k2")


def within_tokens(rows: DataFrame, group: str, order: str, text: str, most: int, tail: int = 50) -> DataFrame:
    """The rows of each group while their tokens fit into `most`; the one that overflows is kept cut
    if more than `tail` tokens are left; nothing after it. Adds tokens, kept_tokens. Rows of equal `order` come
    in an order of their contents, and repeated rows count each."""
    if most <= 0:
        return rows.withColumns({"tokens": T.n_tokens(F.col(text)), "kept_tokens": T.n_tokens(F.col(text))})
    left = most - (F.col("running") - F.col("tokens"))
    whole = F.col("running") <= most
    keep = _counted(rows, group, order, text).withColumn("kept_tokens", F.when(whole, F.col("tokens")).when(left > tail, left).cast("int"))
    return _kept(rows, keep.where("kept_tokens is not null").drop("running", "nth"), group, order)


def within_tokens_keep_first(rows: DataFrame, group: str, order: str, text: str, most: int) -> DataFrame:
    """A prefix of each group within `most` tokens; the first row stays even when it is larger. Adds tokens, running, nth.
    Rows of equal `order` come in an order of their contents, and repeated rows count each."""
    return _kept(rows, _counted(rows, group, order, text).where(f"nth = 1 or running <= {most}"), group, order)


def hierarchical_chunks(docs: DataFrame, sizes: tuple[int, ...] = (2048, 1024, 512)) -> DataFrame:
    """doc_id, level, chunk, parent, text: characters in ever smaller chunks, each inside its parent's."""
    out = None
    for level, size in enumerate(sizes):
        n = F.greatest(F.lit(1), F.ceil(F.length("text") / size).cast("int"))
        one = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk")).select(
            "doc_id", F.lit(level).alias("level"), "chunk",
            (F.floor(F.col("chunk") / (sizes[level - 1] // size)).cast("int") if level else F.lit(None).cast("int")).alias("parent"),
            F.substring(F.col("text"), F.col("chunk") * size + 1, F.lit(size)).alias("text"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def auto_merge(hits: DataFrame, chunks: DataFrame, ratio: float = 0.5) -> DataFrame:
    """Leaf hits (qid, doc_id, chunk, score): a parent of which more than `ratio` of the leaves were hit
    replaces them with their mean score. qid, doc_id, level, chunk, score."""
    leaf = chunks.agg(F.max("level")).first()[0]
    leaves = chunks.where(F.col("level") == leaf)
    family = leaves.groupBy("doc_id", "parent").agg(F.count("*").alias("leaves"))
    placed = hits.join(leaves.select("doc_id", "chunk", "parent"), ["doc_id", "chunk"])
    by = placed.groupBy("qid", "doc_id", "parent").agg(F.count("*").alias("hit"), F.avg("score").alias("mean")).join(family, ["doc_id", "parent"])
    merged = by.where(F.col("hit") > ratio * F.col("leaves"))
    kept = placed.join(merged.select("qid", "doc_id", "parent"), ["qid", "doc_id", "parent"], "left_anti")
    return kept.select("qid", "doc_id", F.lit(leaf).alias("level"), "chunk", "score").unionByName(
        merged.select("qid", "doc_id", F.lit(leaf - 1).alias("level"), F.col("parent").alias("chunk"), F.col("mean").alias("score"))
    )


def enrich(hits: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entity hits (qid, id, score) with their nodes and degrees, and their incident edges on sorted ends."""
    from .hub import degrees

    found = hits.join(nodes, "id").join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    ends = edges.select("src", "dst", "relation", "weight")
    touched = hits.select("qid", F.col("id").alias("src")).join(ends, "src").unionByName(
        hits.select("qid", F.col("id").alias("dst")).join(ends, "dst").select("qid", "src", "dst", "relation", "weight")
    )
    pair = touched.groupBy("qid", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("weight").alias("weight"))
    return found, pair


def endpoints(hits: DataFrame, k: int) -> DataFrame:
    """The ends of relation hits (qid, src, dst, and a rank of any type that orders them) in first-seen order: qid, id, rank."""
    ends = hits.select("qid", F.posexplode(F.array("src", "dst")).alias("side", "id"), F.col("rank").alias("place"))
    kept = ends.groupBy("qid", "id").agg(F.min(F.struct("place", "side")).alias("m"))
    return ranked(kept, "qid", [F.col("m.place"), F.col("m.side")], k).select("qid", "id", "rank")


def _shingle_hashes(words: Column, n: int) -> Column:
    """A hash of each run of `n` elements."""
    last = F.size(words) - n + 1
    places = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.slice(words, i, F.lit(n))))


def _grams(text: Column, n: Column | int) -> Column:
    """The distinct strings of `n` characters in a text."""
    last = F.length(text) - n + 1
    places = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substr(text, i, F.lit(n) if isinstance(n, int) else n)))


def _through(asked: DataFrame, held: DataFrame, named: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (item_id, doc_id) that meet on an item's rarest piece and are verified: `asked` has (item_id, h), `held` (doc_id, h)."""
    wanted = asked.select("h").distinct()
    places = cut(held.join(carried(wanted), "h", "left_semi"))
    often = places.groupBy("h").agg(F.count("*").alias("df"))
    rarest = asked.join(often, "h", "left").groupBy("item_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h")).alias("m"))
    met = cut(places.join(carried(rarest.where("m.df > 0").select("item_id", F.col("m.h").alias("h"))), "h").select("item_id", "doc_id"))
    # Few pairs go to the texts, so that these stay where they lie.
    held_by = docs.select("doc_id", "text").join(carried(met), "doc_id")
    return held_by.join(carried(named.select("item_id", "t")), "item_id").where(F.col("text").contains(F.col("t"))).select("item_id", "doc_id")


def containing_pairs(items: DataFrame, docs: DataFrame, shorter: bool = False) -> DataFrame:
    """All (item_id, doc_id) whose document text contains the item's (non-empty) text.

    The parts of an item between its first and last space stand as whole parts
    in any text that holds it, so up to three of them, as one hash, meet the
    documents' runs of as many parts in an equi-join. Items of two parts or
    fewer meet the documents on up to three of their characters instead. Of an
    item's pieces the one that fewest documents hold is taken, and what meets
    is verified. With `shorter`, items longer than the longest document are
    dropped first.
    """
    if shorter:
        longest = docs.agg(F.max(F.length("text"))).first()[0] or 0
        items = items.where(F.length("text") <= longest)
    parts = lambda: F.split("text", " ")
    # Columns of their own: within a lambda, an expression is evaluated again for each element.
    named = items.where("length(text) > 0").select("item_id", F.col("text").alias("t"), F.least(F.lit(3), F.size(parts()) - 2).alias("n"), parts().alias("w"))
    inner = named.where("n > 0").select("item_id", "t", "n", F.slice("w", F.lit(2), F.size("w") - 2).alias("w"))
    runs = F.when(F.col("n") == 3, _shingle_hashes(F.col("w"), 3)).when(F.col("n") == 2, _shingle_hashes(F.col("w"), 2)).otherwise(_shingle_hashes(F.col("w"), 1))
    asked = cut(inner.select("item_id", "n", F.explode(F.array_distinct(runs)).alias("h")))
    short = cut(named.where("n < 1").select("item_id", "t", F.least(F.lit(3), F.length("t")).alias("n")))
    found = [items.join(docs, F.lit(False)).select("item_id", "doc_id")]
    lengths = [r["n"] for r in asked.select("n").distinct().collect()]  # 1, 2 and 3 at most
    if lengths:
        held = F.concat(*[_shingle_hashes(F.col("w"), n) for n in lengths])
        words = spread(docs.select("doc_id", "text")).select("doc_id", parts().alias("w"))
        found.append(_through(asked.select("item_id", "h"), words.select("doc_id", F.explode(F.array_distinct(held)).alias("h")), named, docs))
    sizes = [r["n"] for r in short.select("n").distinct().collect()]
    if sizes:
        pieces = short.select("item_id", F.explode(_grams(F.col("t"), F.col("n"))).alias("h"))
        held = F.concat(*[_grams(F.col("text"), n) for n in sizes])
        found.append(_through(pieces, spread(docs.select("doc_id", "text")).select("doc_id", F.explode(held).alias("h")), short, docs))
    return reduce(DataFrame.unionByName, found).distinct()


def containment(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks (chunk_id, text) with the first document (doc_id, text) that contains them or is contained: chunk_id, doc_id."""
    a = containing_pairs(chunks.withColumnRenamed("chunk_id", "item_id"), docs).select(F.col("item_id").alias("chunk_id"), "doc_id")
    b = containing_pairs(docs.withColumnRenamed("doc_id", "item_id"), chunks.withColumnRenamed("chunk_id", "doc_id"), shorter=True).select(
        F.col("doc_id").alias("chunk_id"), F.col("item_id").alias("doc_id")
    )
    return a.unionByName(b).groupBy("chunk_id").agg(F.min("doc_id").alias("doc_id"))


def with_fallback(ids: DataFrame, mapping: DataFrame) -> DataFrame:
    """Ids (id, ...) with what they map to (chunk_id, doc_id); unmapped ones pass unchanged."""
    return ids.join(mapping.select(F.col("chunk_id").alias("id"), "doc_id"), "id", "left").withColumn("resolved", F.coalesce(F.col("doc_id").cast("string"), F.col("id").cast("string"))).drop("doc_id")


def ablations(components: list[str], spark) -> DataFrame:
    """All on/off combinations of the components, by size: combo, n, names."""
    n = len(components)
    names = F.filter(F.array(*[F.when(F.col("combo").bitwiseAND(F.lit(1 << i)) > 0, F.lit(c)) for i, c in enumerate(components)]), lambda x: x.isNotNull())
    return spark.range(1 << n).withColumnRenamed("id", "combo").select("combo", F.size(names).alias("n"), F.array_join(names, "+").alias("names"))


def filtered(scores: DataFrame, items: DataFrame, conditions: list[Column], k: int) -> DataFrame:
    """Self-query: scores over the items that pass the filters (which reach the items' scan), cut to `k`."""
    kept = items
    for c in conditions:
        kept = kept.where(c)
    return top(scores.join(kept.select("id"), "id", "left_semi"), k)


def retrieved_ids(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The chunk ids behind nodes (qid, name, score, source_id) and edges (qid, src, dst, weight, source_id): qid, id, rank.

    Nodes by score and name, then edges by weight and pair, all descending;
    each one's <SEP> list in its order; the first occurrence of an id stays.
    """
    pair = F.concat_ws("|", F.least("src", "dst"), F.greatest("src", "dst"))
    both = nodes.select("qid", F.lit(0).alias("s"), F.col("score").cast("double").alias("v"), F.col("name").alias("n"), "source_id").unionByName(
        edges.select("qid", F.lit(1).alias("s"), F.col("weight").cast("double").alias("v"), pair.alias("n"), "source_id")
    )
    listed = both.select("qid", "s", (-F.col("v")).alias("v"), "n", F.posexplode(T.chunk_ids(F.col("source_id"))).alias("pos", "id"))
    # Names are to descend, so the first of an id is found by window and not by a least struct; each task keeps one of an id.
    order = [F.col("s"), F.col("v"), F.col("n").desc(), F.col("pos")]
    first = listed.withColumn("k", F.row_number().over(Window.partitionBy("qid", "id").orderBy(*order))).where("k = 1").drop("k")
    return running_sums(first.withColumn("one", F.lit(1)), "qid", order, "one").select("qid", "id", F.col("nth").cast("int").alias("rank"))


def zipped(first: DataFrame, second: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """The values of two lists of each group side by side by place, as far as both go: group, place, a, b."""
    over = Window.partitionBy(group).orderBy(order)
    nth = lambda df, name: df.select(group, F.row_number().over(over).alias("place"), F.col(value).alias(name))
    return nth(first, "a").join(nth(second, "b"), [group, "place"])


def head_sample(docs: DataFrame, order: str, text: str, n: int, chars: int) -> DataFrame:
    """The first `n` documents with the first `chars` characters of their text."""
    return docs.orderBy(order).limit(n).withColumn(text, F.substring(text, 1, chars))


def single(lists: list[DataFrame], k: int) -> DataFrame:
    """The first list alone, cut to `k`."""
    return concatenate(lists[:1], k)


def scaled(rows: DataFrame, group: str, value: str, name: str = "scaled") -> DataFrame:
    """`rows` with `value` scaled to [0, 1] within its group as `name`: 0 in groups of one value, null for null.

    The bounds are sums over the groups and go back to the rows, so that a group of any size stays spread.
    """
    bounds = rows.groupBy(F.col(group).alias("__g")).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    met = rows.join(carried(bounds), F.col(group).eqNullSafe(F.col("__g")), "left")
    part = (F.col(value) - F.col("__low")) / (F.col("__high") - F.col("__low"))
    return met.withColumn(name, F.when(F.col(value).isNotNull(), F.when(F.col("__high") > F.col("__low"), part).otherwise(0.0))).drop("__g", "__low", "__high")


def linked(entities: DataFrame, relations: DataFrame, k: int) -> DataFrame:
    """Seeds of a question: its entity hits (qid, id, rank) and the ends of its relation hits (qid, src, dst, rank) in turn: qid, name, source, rank."""
    local = entities.select("qid", F.col("id").alias("name"), "rank")
    return round_robin(local, endpoints(relations, k).withColumnRenamed("id", "name"), k)
