"""Graph patterns as filters: the names, labels, relation types and properties of a question in pattern syntax.

No query language is run: what a pattern mentions becomes filters over triples,
each wider one only where the narrower ones find nothing.
"""

from __future__ import annotations

import re
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .hub import Graph
from .lineage import cut
from .sizes import carried


@dataclass(frozen=True)
class Mentions:
    names: tuple[str, ...]
    labels: tuple[str, ...]
    relations: tuple[str, ...]


def mentions(pattern: str) -> Mentions:
    """Quoted names after name:, name =, name IN or CONTAINS, labels of (x:Label), and types of [r:TYPE|OTHER]."""
    names = re.findall(r"\bname\s*(?::|=|CONTAINS)\s*[\"']([^\"']+)[\"']", pattern, re.IGNORECASE)
    for listed in re.findall(r"\bname\s+IN\s*\[([^\]]*)\]", pattern, re.IGNORECASE):
        names += re.findall(r"[\"']([^\"']+)[\"']", listed)
    labels = re.findall(r"\(\s*\w*\s*:\s*`?(\w+)", pattern)
    relations = [t.strip(" :`") for ts in re.findall(r"\[\s*\w*\s*:([^\]{}*]+)", pattern) for t in ts.split("|")]
    once = lambda xs: tuple(dict.fromkeys(x for x in xs if x))
    return Mentions(once(names), once(labels), once(relations))


def select(graph: Graph, pattern: str) -> DataFrame:
    """src, relation, dst of the triples that a pattern is after.

    With names or relations: triples of such a relation (case ignored) with an
    end of such a name, its other end of a mentioned label, each as far as it is
    mentioned. If there are none, triples between nodes of the labels; then none.
    """
    said = mentions(pattern)
    nodes = graph.nodes.select("id", "name", F.lower("type").alias("type"))
    ends = graph.edges.select("src", "relation", "dst").distinct()
    typed = ends.join(nodes.select(F.col("id").alias("src"), F.col("name").alias("sn"), F.col("type").alias("st")), "src").join(
        nodes.select(F.col("id").alias("dst"), F.col("name").alias("dn"), F.col("type").alias("dt")), "dst"
    )
    labels = [x.lower() for x in said.labels]
    fits = (F.col("st").isin(labels) & F.col("dt").isin(labels)) if labels else F.lit(True)
    narrow = fits
    if said.names:
        narrow &= F.col("sn").isin(*said.names) | F.col("dn").isin(*said.names)
    if said.relations:
        narrow &= F.lower("relation").isin([x.lower() for x in said.relations])
    found = typed.where(narrow).select("src", "relation", "dst")
    if not (said.names or said.relations):
        return found if labels else typed.where(F.lit(False)).select("src", "relation", "dst")
    return found if not labels or not found.isEmpty() else typed.where(fits).select("src", "relation", "dst")


@F.pandas_udf(StructType([StructField(n, ArrayType(StringType())) for n in ("names", "labels", "relations")]))
def _said(patterns: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([[list(x) for x in astuple(mentions(p or ""))] for p in patterns], columns=["names", "labels", "relations"])


def select_each(graph: Graph, patterns: DataFrame) -> DataFrame:
    """What select() finds for each of `patterns` (qid, pattern): qid, src, relation, dst.

    Patterns are parsed where they lie. Those with names meet the nodes of such
    names and the triples around these; those with relations alone meet the
    triples of these relations; the others, and those that found nothing,
    the triples between their labels. Names and relations go to the triples
    first, and only what they meet asks for its ends' types; of the nodes only
    those of mentioned types are asked, unless a pattern mentions none.
    """
    said = patterns.select("qid", _said("pattern").alias("m")).select("qid", "m.names", *[F.transform(f"m.{c}", F.lower).alias(c) for c in ("labels", "relations")])
    said = cut(said)
    nodes = graph.nodes.select("id", "name", F.lower("type").alias("type"))
    ends = graph.edges.select("src", "relation", "dst")
    of_types = lambda rows: nodes.join(carried(rows.select(F.explode("labels").alias("type")).distinct()), "type", "left_semi")

    def typed(df: DataFrame, known: DataFrame) -> DataFrame:
        """`df` (src, dst, ...) with its ends' types; ends that aren't known go."""
        known = carried(known.select("id", "type"))
        return df.join(known.select(F.col("id").alias("src"), F.col("type").alias("st")), "src").join(known.select(F.col("id").alias("dst"), F.col("type").alias("dt")), "dst")

    fits = (F.size("labels") == 0) | (F.array_contains("labels", F.col("st")) & F.array_contains("labels", F.col("dt")))
    related = (F.size("relations") == 0) | F.array_contains("relations", F.lower("relation"))
    asking = said.where((F.size("names") > 0) | (F.size("relations") > 0))
    known = nodes if not asking.where(F.size("labels") == 0).isEmpty() else of_types(asking)
    named = said.where(F.size("names") > 0).select("qid", "labels", "relations", F.explode("names").alias("name"))
    named = carried(cut(nodes.select("id", "name").join(carried(named), "name").drop("name")))
    bare = said.where((F.size("names") == 0) & (F.size("relations") > 0)).select("qid", "labels", F.explode("relations").alias("low"))
    shown = lambda df: df.select("qid", "src", "relation", "dst")
    met = lambda df: df.select("qid", "labels", "src", "relation", "dst")
    touched = met(ends.join(named, F.col("src") == F.col("id")).where(related)).unionByName(met(ends.join(named, F.col("dst") == F.col("id")).where(related)))
    touched = touched.unionByName(met(ends.withColumn("low", F.lower("relation")).join(carried(bare), "low")))
    narrow = cut(shown(typed(touched, known).where(fits)).distinct())
    rest = cut(said.where(F.size("labels") > 0).join(narrow.select("qid").distinct(), "qid", "left_anti"))
    pairs = rest.select("qid", F.explode("labels").alias("st"), "labels").select("qid", "st", F.explode("labels").alias("dt"))
    return narrow.unionByName(shown(typed(ends, of_types(rest)).join(carried(pairs), ["st", "dt"])).distinct())
