"""Command line: ``python -m graphloom.cli COMMAND``, or the same file by spark-submit."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options: str, **flags):
        c = sub.add_parser(name)
        for o in options:
            c.add_argument(o)
        for k, v in flags.items():
            flag = "--" + k.replace("_", "-")
            if v is False:
                c.add_argument(flag, action="store_true")
            else:
                c.add_argument(flag, default=v, type=str if v is None else type(v))
        return c

    command("queries")
    command("run", "query", "root", out=None)
    command("link", "root", "out")
    command("split-graph", "graph", "out")
    command("search", "root", "text", limit=20, hops=2, node_types=None, modules=None)
    command("search-federated", "root", "text", limit=20)
    command("build-index", "root", "index", model="none", force=False)
    command("normalize", "root", "out")
    command("vectorize", "root", "out", dimensions=64)
    command("validate-graph", "root")
    command("validate-index", "root", "index", model="none")
    command("validate-environment", "work_dir")
    return p


def _exit_code(rows: DataFrame) -> int:
    rows.show(200, truncate=120)
    return 1 if rows.where("status = 'ERROR'").limit(1).count() else 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    from graphloom.operators import checks, corpus, federated, graph, index, lexical, vector
    from graphloom.plans import catalog_graph
    from graphloom.queries import queries
    from graphloom.sources.files import write_layers
    from graphloom.sources.tables import read_table

    if a.command == "queries":
        print("\n".join(queries()))
        return 0
    spark = spark or SparkSession.builder.appName("graphloom").getOrCreate()
    split = lambda v: v.split(",") if v else None
    if a.command == "run":
        df = queries()[a.query](spark, a.root)
        df.write.mode("overwrite").parquet(a.out) if a.out else df.show(50, truncate=100)
    elif a.command == "link":
        n, e = catalog_graph.graph(spark, a.root)
        n.write.mode("overwrite").parquet(f"{a.out}/nodes")
        e.write.mode("overwrite").parquet(f"{a.out}/edges")
    elif a.command == "split-graph":
        n, e = graph.split_layers(spark.read.parquet(f"{a.graph}/nodes"), spark.read.parquet(f"{a.graph}/edges"))
        write_layers(n, f"{a.out}/nodes")
        write_layers(e, f"{a.out}/edges")
    elif a.command == "search":
        n, e = catalog_graph.graph(spark, a.root)
        lexical.hybrid_search(n, e, a.text, a.limit, a.hops, split(a.node_types), split(a.modules)).show(a.limit, truncate=80)
    elif a.command == "search-federated":
        n, e = catalog_graph.graph(spark, a.root)
        q = spark.createDataFrame([("0", a.text)], "query_id string, text string")
        core = n.where(F.col("node_type").isin(*graph.CORE_TYPES))
        scores = lexical.direct_scores(core, q).select("query_id", "id", "node_type", "title", F.col("direct_score").alias("score"))
        routed = federated.routes(federated.master_seeds(scores), e)
        similarity = n.select(F.lit("0").alias("query_id"), F.col("id").alias("node"), F.lit(None).cast("double").alias("similarity"), "title")
        parts = [routed.withColumn("priority", F.when(F.col("reason") == "seed", 0).otherwise(1)), federated.expand_physical(routed, e, similarity, n).withColumn("priority", F.when(F.col("reason") == "bridge", 2).otherwise(3))]
        federated.merge_candidates(parts).orderBy("rank").show(a.limit, truncate=80)
    elif a.command in ("build-index", "validate-index"):
        n, e = graph.split_layers(*catalog_graph.graph(spark, a.root))
        n = n.select("id", "node_type", "title", "search_text", "modules", "graph_layer")
        e = e.select("source", "target", "type", "weight", "graph_layer")
        if a.command == "build-index":
            index.build_index(n, e, a.index, a.model, a.force).show(truncate=False)
        else:
            stale = index.stale_layers(n, e, a.index, a.model)
            return _exit_code(checks.check(stale, "index", a.index, F.count(F.lit(1)), "stale_layers", "INDEX_STALE", ok_code="INDEX_FRESHNESS"))
    elif a.command == "normalize":
        corpus.distinct_texts(read_table(spark, a.root, "documents"), F.col("text")).write.mode("overwrite").parquet(a.out)
    elif a.command == "vectorize":
        texts = corpus.distinct_texts(read_table(spark, a.root, "documents"), F.col("text"))
        empty = spark.createDataFrame([], "text_hash string, model_name string, embedding_profile_version string, dimensions int, embedding array<float>")
        corpus.vectorize(texts, empty, vector.hashing_encoder(a.dimensions), "hashing", "1", a.dimensions).write.mode("overwrite").parquet(a.out)
    elif a.command == "validate-graph":
        return _exit_code(checks.validate_graph(*catalog_graph.graph(spark, a.root), "all"))
    elif a.command == "validate-environment":
        return _exit_code(checks.validate_environment(spark, a.work_dir))
    return 0


if __name__ == "__main__":
    sys.exit(main())
