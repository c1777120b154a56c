"""From the names that a question and its documents mention to nodes, contexts and ids; filters over entities and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .hub import Graph
from .lineage import cut
from .retrieve import contexts
from .traverse import edges_between, khop


def holds(source: str | None = None, least: float | None = None, **equal: str) -> Column:
    """A filter over entities or relations: columns equal to what is named, `source` within the source, confidence of `least` or more.

    Nulls pass no condition that is asked for; without conditions all rows pass.
    """
    out = F.lit(True)
    for column, value in equal.items():
        out = out & (F.col(column) == value)
    if source is not None:
        out = out & F.col("source").contains(source)
    if least is not None:
        out = out & (F.col("confidence") >= least)
    return F.coalesce(out, F.lit(False))


def touching(edges: DataFrame, ids: DataFrame, side: str = "both") -> DataFrame:
    """Relations with one of `ids` (column id) at their head (src), tail (dst) or either, each once."""
    ends = {"src": ["src"], "dst": ["dst"], "both": ["src", "dst"]}[side]
    one = lambda c: edges.join(ids.select(F.col("id").alias(c)).distinct(), c, "left_semi").select(*edges.columns)
    if len(ends) == 1:
        return one(ends[0])
    rest = edges.join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_anti").select(*edges.columns)
    return one("src").unionByName(rest.join(ids.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select(*edges.columns))


def schema_item(item: Column) -> Column:
    """Name and description of a schema's type, given as plain text or as a JSON object (name, type or label; description or desc).

    Null where nothing is left of the name.
    """
    fields = F.from_json(F.when(F.trim(item).startswith("{"), item), "map<string,string>")
    first = lambda *names: T.first_present(*[fields[n] for n in names])
    name = F.when(fields.isNotNull(), first("name", "type", "label")).otherwise(T.present(item))
    return F.when(name.isNotNull(), F.struct(name.alias("name"), F.coalesce(first("description", "desc"), F.lit("")).alias("description")))


def _key(name: str) -> Column:
    return F.lower(F.trim(name))


def anchors(mentions: DataFrame, names: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """The nodes that a question starts from: qid, id, rank.

    `mentions` (qid, pos, entity) are the names that a question, then its
    documents, bring, in order; `names` (id, name) are the nodes' names and
    aliases, a row each, compared without case and blanks around. A name that
    several nodes have stands for all of them, by id. Behind them come the
    `documents` (qid, pos, id) that a vector search found. Each id is there
    once, at its first place; blank and unknown names bring nothing.
    """
    known = names.select("id", _key("name").alias("key")).where("key <> ''").distinct()
    found = mentions.select("qid", F.lit(0).alias("part"), "pos", _key("entity").alias("key")).join(known, "key").select("qid", "part", "pos", "id")
    if documents is not None:
        found = found.unionByName(documents.where("id is not null").select("qid", F.lit(1).alias("part"), "pos", "id"))
    first = found.groupBy("qid", "id").agg(F.min(F.struct("part", "pos")).alias("at"))
    order = Window.partitionBy("qid").orderBy("at.part", "at.pos", "id")
    return first.withColumn("rank", F.row_number().over(order)).select("qid", "id", "rank")


def answer_contexts(graph: Graph, seeds: DataFrame, hops: int = 1, top_k: int = 20) -> tuple[DataFrame, DataFrame]:
    """What a question gets from the graph around its anchors (qid, id): context lines (qid, section, rank, context) and ids (qid, id, rank).

    The best `top_k` nodes within `hops` by degree, then hop and id; their
    lines come first, then those of the edges between them, heaviest first.
    Equal lines stand once. Questions without anchors get nothing.
    """
    near, _ = khop(graph, seeds, hops, top_k)
    place = Window.partitionBy("qid").orderBy(F.desc("degree"), "hop", "id")
    ids = cut(near.withColumnRenamed("rank", "degree").withColumn("rank", F.row_number().over(place)).select("qid", "id", "rank"))  # found once, for nodes and both ends
    nodes = ids.join(graph.nodes.select("id", F.concat_ws(" ", "type", "name").alias("description")), "id")
    line = F.format_string("%s -[%s]-> %s", "src", "relation", "dst")
    heavy = Window.partitionBy("qid").orderBy(F.desc("weight"), "src", "relation", "dst")
    edges = edges_between(graph, ids).withColumn("rank", F.row_number().over(heavy)).select("qid", "rank", line.alias("description"))
    return contexts(nodes, edges), ids
