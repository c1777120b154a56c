"""The base tables, and a catalogue of datasets by name."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str) -> None:
    """All tables as temporary views."""
    for name in TABLES:
        load(spark, sf_dir, name).createOrReplaceTempView(name)


@dataclass
class DatasetCatalogue:
    """Datasets by name: shared defaults under the overrides of each dataset."""

    defaults: dict[str, str] = field(default_factory=dict)
    datasets: dict[str, dict[str, str]] = field(default_factory=dict)

    def resolve(self, name: str) -> dict[str, str]:
        if name not in self.datasets:
            raise KeyError(f"unknown dataset {name!r}; known: {', '.join(sorted(self.datasets))}")
        return {**self.defaults, **self.datasets[name]}


def artifact_name(data_type: str, method: str, mode: str = "", top_k: int = 0, tag: str = "", fast: bool = False) -> str:
    """data_type_method[_mode][_kN][_tag][_fast_test]: the name that a stored artifact goes by."""
    parts = [data_type, method, mode, f"k{top_k}" if top_k else "", tag, "fast_test" if fast else ""]
    return "_".join(p for p in parts if p)
