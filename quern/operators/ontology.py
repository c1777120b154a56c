"""A graph built in batches from typed triples, with a schema that evolves on the way.

Triples are rows (subject, subject_type, relation, object, object_type). The
graph and its schema live as Parquet in one folder, a part for each round, so
that a round writes what is new and nothing else, reads no more than keys of
what is there, and can be run again after a failure.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hub import Graph

NODE = "id string, type string"
EDGE = "src string, dst string, relation string, known boolean"
RELATION = "relation string, head_type string, tail_type string, seen long"
_SIGNATURE = ["relation", "head_type", "tail_type"]


def signatures(triples: DataFrame) -> DataFrame:
    """Relations with the types of their ends, and how often each is seen."""
    return triples.groupBy("relation", F.col("subject_type").alias("head_type"), F.col("object_type").alias("tail_type")).agg(F.count("*").alias("seen"))


@dataclass
class OntologyGraph:
    """The running graph in `folder`. `mode` says what becomes of the schema:

    * fixed: it is what `start()` was given;
    * learned: what the first round holds, given or not, and nothing later;
    * evolved: each of the first `evolving` rounds adds what it sees `least` times or more, until `patience`
      rounds in a row added nothing.
    """

    spark: SparkSession
    folder: str
    mode: str = "evolved"
    evolving: int = 1 << 30
    least: int = 2
    patience: int | None = None

    def __post_init__(self) -> None:
        if self.mode not in ("fixed", "learned", "evolved"):
            raise ValueError(f"unknown mode {self.mode!r}; known: fixed, learned, evolved")

    def _read(self, name: str, schema: str, before: int) -> DataFrame:
        """The parts of rounds before `before`; parts of a round that broke off are written anew and not read."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema + ", round int")
        return self.spark.read.schema(schema + ", round int").parquet(f"{self.folder}/{name}").where(F.col("round") < before)

    def _write(self, name: str, rows: DataFrame, k: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/round={k}")

    def start(self, relations: DataFrame) -> None:
        """A given schema (relation, head_type, tail_type), as round 0."""
        self._write("schema", relations.select(*_SIGNATURE, F.lit(0).cast("long").alias("seen")), 0)

    def schema(self, before: int = 1 << 30) -> DataFrame:
        return self._read("schema", RELATION, before)

    def nodes(self, before: int = 1 << 30) -> DataFrame:
        return self._read("nodes", NODE, before)

    def edges(self, before: int = 1 << 30) -> DataFrame:
        return self._read("edges", EDGE, before)

    def graph(self) -> Graph:
        return Graph(self.nodes().select("id", "type", F.col("id").alias("name")), self.edges().select("src", "dst", "relation", F.lit(1.0).alias("weight")))

    def _learns(self, k: int) -> bool:
        if self.mode == "fixed" or self.mode == "learned" and k > 1 or k > self.evolving:
            return False
        if self.mode == "learned" or self.patience is None or k <= self.patience:
            return True
        return not self.schema(k).where(F.col("round") >= k - self.patience).isEmpty()

    def insert(self, triples: DataFrame, k: int) -> None:
        """Round `k` (from 1): the schema first, then the nodes and edges that are not there yet.

        A node keeps the type that it came with first (of one round the least);
        an edge is known if its relation and types are in the schema by then.
        Triples without a subject, relation or object are left out.
        """
        rows = triples.where("subject is not null and relation is not null and object is not null")
        if self._learns(k):
            frequent = signatures(rows).where(F.col("seen") >= (1 if self.mode == "learned" else self.least))
            self._write("schema", self._fresh(frequent, self.schema(k), _SIGNATURE), k)
        ends = rows.select(F.explode(F.array(F.struct(F.col("subject").alias("id"), F.col("subject_type").alias("type")), F.struct(F.col("object").alias("id"), F.col("object_type").alias("type")))).alias("n"))
        nodes = ends.select("n.*").groupBy("id").agg(F.min("type").alias("type"))
        self._write("nodes", nodes.join(self.nodes(k).select("id"), "id", "left_anti"), k)
        schema = self.schema(k + 1).select(*_SIGNATURE).distinct().withColumn("there", F.lit(True))
        typed = rows.select(F.col("subject").alias("src"), F.col("object").alias("dst"), "relation", F.col("subject_type").alias("head_type"), F.col("object_type").alias("tail_type"))
        match = [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in _SIGNATURE]
        marked = typed.join(schema.withColumnsRenamed({c: f"s_{c}" for c in _SIGNATURE}), match[0] & match[1] & match[2], "left")
        edges = marked.groupBy("src", "dst", "relation").agg(F.max(F.coalesce("there", F.lit(False))).alias("known"))
        self._write("edges", self._fresh(edges, self.edges(k), ["src", "dst", "relation"]), k)

    @staticmethod
    def _fresh(rows: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
        old = there.select(*[F.col(c).alias(f"o_{c}") for c in keys]).distinct()
        same = F.lit(True)
        for c in keys:
            same = same & F.col(c).eqNullSafe(F.col(f"o_{c}"))
        return rows.join(old, same, "left_anti")

    def build(self, triples: DataFrame, pos: str, total: int, share: float = 0.1, evolve: float = 0.5) -> int:
        """All of `triples`, whose column `pos` counts their documents from 0 to `total` - 1, in batches of a
        tenth (`share`, one document at least); the schema evolves over the first half (`evolve`) of the
        rounds. Returns their number."""
        size = max(1, int(total * share))
        rounds = -(-total // size)
        self.evolving = max(1, int(rounds * evolve))
        for k in range(1, rounds + 1):
            self.insert(triples.where((F.col(pos) >= (k - 1) * size) & (F.col(pos) < k * size)), k)
        return rounds

    def rounds(self, count: int) -> DataFrame:
        """State after each round: round, new and all nodes, edges, known edges and relations of the schema."""
        every = self.spark.range(1, count + 1).select(F.col("id").cast("int").alias("round"))
        for name, part in (("nodes", self.nodes()), ("edges", self.edges()), ("known", self.edges().where("known")), ("relations", self.schema())):
            n = part.groupBy("round").agg(F.count("*").alias("n")).select(F.col("round").alias("r"), "n")
            # A row for each pair of rounds, of which there are about as many as one over the share.
            new = F.coalesce(F.sum(F.when(F.col("r") == F.col("round"), F.col("n"))), F.lit(0)).alias(f"new_{name}")
            every = every.join(n, F.col("r") <= F.col("round"), "left").groupBy(*every.columns).agg(new, F.coalesce(F.sum("n"), F.lit(0)).alias(name))
        return every
