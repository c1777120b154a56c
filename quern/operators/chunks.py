"""The graph of a document's chunks, and retrieval that walks it from vector hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hub import Graph
from .lineage import cut


def chunk_graph(chunks: DataFrame) -> Graph:
    """hierarchical_chunks() as a graph: nodes doc:level:chunk, relations parent, previous and next.

    All edges follow from a chunk's own numbers, so nothing is joined.
    """
    at = lambda level, chunk: F.concat_ws(":", "doc_id", level, chunk)
    own, level, chunk = at(F.col("level"), F.col("chunk")), F.col("level"), F.col("chunk")
    edge = lambda a, relation, b: F.struct(a.alias("src"), F.lit(relation).alias("relation"), b.alias("dst"))
    up = F.when(F.col("parent").isNotNull(), edge(own, "parent", at(level - 1, F.col("parent"))))
    back = F.when(chunk > 0, edge(own, "previous", at(level, chunk - 1)))
    forth = F.when(chunk > 0, edge(at(level, chunk - 1), "next", own))
    edges = chunks.select(F.explode(F.array_compact(F.array(up, back, forth))).alias("e")).select("e.*", F.lit(1.0).alias("weight"))
    return Graph(chunks.select(own.alias("id"), F.lit("chunk").alias("type"), F.col("text").alias("name")), edges)


def vector_context(graph: Graph, hits: DataFrame, depth: int = 1, most: int = 30, relations: list[str] | None = None) -> DataFrame:
    """The triples within `depth` steps of a query's hits (qid, id, score): qid, src, relation, dst, hop, score, rank.

    Edges are walked both ways, along `relations` only if these are given. A
    triple has the hop at which it is first seen and the best score of the
    hits that see it then; the `most` first by hop, score, and its names stay.
    """
    edges = graph.edges.select("src", "relation", "dst").distinct()
    if relations is not None:
        edges = edges.where(F.col("relation").isin(*relations))
    edges = cut(edges)
    both = edges.select("*", F.col("src").alias("from"), F.col("dst").alias("to")).unionByName(edges.select("*", F.col("dst").alias("from"), F.col("src").alias("to")))
    front = hits.groupBy("qid", "id").agg(F.max("score").alias("score")).join(graph.nodes.select("id"), "id", "left_semi")
    seen, found = cut(front), None
    front = seen
    for hop in range(1, depth + 1):
        step = cut(front.join(both, F.col("id") == F.col("from")).select("qid", "src", "relation", "dst", "to", "score"))
        one = step.select("qid", "src", "relation", "dst", F.lit(hop).alias("hop"), "score")
        found = one if found is None else found.unionByName(one)
        new = step.groupBy("qid", F.col("to").alias("id")).agg(F.max("score").alias("score"))
        front = cut(new.join(seen.select("qid", "id"), ["qid", "id"], "left_anti").select("id", "qid", "score"))
        seen = seen.unionByName(front)
    first = found.groupBy("qid", "src", "relation", "dst").agg(F.min(F.struct("hop", (-F.col("score")).alias("neg"))).alias("m"))
    rows = first.select("qid", "src", "relation", "dst", "m.hop", (-F.col("m.neg")).alias("score"))
    order = Window.partitionBy("qid").orderBy("hop", F.desc("score"), "src", "relation", "dst")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
