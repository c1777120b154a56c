"""A query engine for retrieval and knowledge-graph workloads, on Spark."""
