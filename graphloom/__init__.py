"""graphloom: a Spark-first engine for documentation graphs, retrieval and corpus analytics."""

__version__ = "0.1.0"
