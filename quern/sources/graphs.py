"""Graph files: GraphML and JSON, to and from the hub's nodes and edges."""

from __future__ import annotations

from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hub import Graph
from ..operators.lineage import cut
from ..operators.sizes import carried

_DATA = "array<struct<_key:string,_VALUE:string>>"
#: How many rows a written file has at most, as a reader takes a file whole.
LINES = 400_000


def read_graphml(spark: SparkSession, path: str) -> Graph:
    """GraphML files as nodes (id, type, name, attributes, file) and edges (src, dst, relation, weight, attributes, file).

    Attributes go by the names that the files' keys declare; type, name (or
    label), relation and weight are taken from them, with Entity, the id,
    RELATED_TO and 1 where they are missing. A missing path is an error.
    """
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).withColumn("file", F.col("_metadata.file_path"))
    keys = read("key", "_id string, `_attr.name` string, _for string").select("file", F.col("_id").alias("key"), F.col("`_attr.name`").alias("named"), F.col("_for").alias("of"))
    names = keys.groupBy("file").agg(*[F.map_from_entries(F.collect_set(F.when(F.coalesce("of", F.lit("all")).isin("all", kind), F.struct("key", "named")))).alias(kind) for kind in ("node", "edge")])
    names = carried(cut(names))  # a row for each file goes to the rows, which are not gathered by file
    nodes = read("node", f"_id string, data {_DATA}").join(names, "file", "left")
    edges = read("edge", f"_source string, _target string, data {_DATA}").join(names, "file", "left")

    def attributes(kind: str) -> Column:
        named = F.transform(F.coalesce("data", F.array().cast(_DATA)), lambda d: F.struct(F.coalesce(F.col(kind)[d["_key"]], d["_key"]).alias("k"), d["_VALUE"].alias("v")))
        return F.map_from_entries(F.array_distinct(named))

    a = F.col("attributes")
    return Graph(
        nodes.withColumn("attributes", attributes("node")).select(
            F.col("_id").alias("id"), F.coalesce(a["type"], a["entity_type"], F.lit("Entity")).alias("type"), F.coalesce(a["name"], a["label"], F.col("_id")).alias("name"), "attributes", "file"
        ),
        edges.withColumn("attributes", attributes("edge")).select(
            F.col("_source").alias("src"), F.col("_target").alias("dst"), F.coalesce(a["relation"], a["label"], F.lit("RELATED_TO")).alias("relation"),
            F.coalesce(a["weight"].try_cast("double"), F.lit(1.0)).alias("weight"), "attributes", "file",
        ),
    )


def _quoted(c: Column) -> Column:
    """A column's text within an XML attribute or element."""
    out = F.coalesce(c.cast("string"), F.lit(""))
    for sign in ("&", "<", ">", '"'):
        out = F.replace(out, F.lit(sign), F.lit({'"': "&quot;"}.get(sign, escape(sign))))
    return out


def write_graphml(graph: Graph, path: str) -> None:
    """The graph as a folder of GraphML files: each is whole by itself, with at most LINES rows, nodes or edges of one part.

    Files are gzip files, as their markup takes many times what the tables do.
    Nodes have type and name, edges relation and weight. A reader of the folder
    finds every node and edge once; no part is gathered anywhere.
    """
    names = {"n0": ("node", "type", "string"), "n1": ("node", "name", "string"), "e0": ("edge", "relation", "string"), "e1": ("edge", "weight", "double")}
    keys = "".join(f"<key id={quoteattr(k)} for={quoteattr(f)} attr.name={quoteattr(n)} attr.type={quoteattr(t)}/>" for k, (f, n, t) in names.items())
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="directed">'
    data = lambda k, c: F.concat(F.lit(f'<data key="{k}">'), _quoted(c), F.lit("</data>"))
    node = F.concat(F.lit('<node id="'), _quoted(F.col("id")), F.lit('">'), data("n0", F.col("type")), data("n1", F.col("name")), F.lit("</node>"))
    edge = F.concat(F.lit('<edge source="'), _quoted(F.col("src")), F.lit('" target="'), _quoted(F.col("dst")), F.lit('">'), data("e0", F.col("relation")), data("e1", F.col("weight")), F.lit("</edge>"))
    # A row for the head and one for the foot of each file's rows, which stay in order; the writer begins a file after so many rows.
    most = LINES - 2
    lines = graph.nodes.select(node.alias("value")).unionByName(graph.edges.select(edge.alias("value")))

    def framed(parts):
        yield [head]
        left = most
        for part in parts:
            values = part["value"].tolist()
            while len(values) > left:
                yield [*values[:left], "</graph></graphml>", head]
                values, left = values[left:], most
            yield values
            left -= len(values)
        yield ["</graph></graphml>"]

    def whole(parts):
        import pandas as pd

        for values in framed(parts):
            yield pd.DataFrame({"value": values})

    lines.mapInPandas(whole, "value string").write.mode("overwrite").option("maxRecordsPerFile", LINES).option("compression", "gzip").text(path)


def write_json(graph: Graph, path: str) -> None:
    """entities and relations as JSON lines in two folders."""
    graph.nodes.write.mode("overwrite").json(f"{path}/entities")
    graph.edges.write.mode("overwrite").json(f"{path}/relations")


def read_json(spark: SparkSession, path: str) -> Graph:
    nodes = spark.read.schema("id string, type string, name string").json(f"{path}/entities")
    return Graph(nodes, spark.read.schema("src string, dst string, relation string, weight double").json(f"{path}/relations"))


def graph_files(spark: SparkSession, path: str) -> DataFrame:
    """Each GraphML file with its numbers of nodes and edges, the largest first."""
    g = read_graphml(spark, path)
    n = g.nodes.groupBy("file").agg(F.count("*").alias("nodes"))
    m = g.edges.groupBy("file").agg(F.count("*").alias("edges"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return n.join(m, "file", "full").select("file", zero("nodes"), zero("edges")).orderBy(F.desc("nodes"), "file")
