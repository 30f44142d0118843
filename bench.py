"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time
from pathlib import Path

from pyspark.sql import SparkSession

HEADLINE = ("content_hash", "chunk_lines", "chunk_chars", "incremental_diff", "bm25_topk", "dense_topk", "hybrid_rrf", "multi_rrf", "import_edges", "graph_stats", "impact_bfs", "resolve_calls", "symbol_context", "entry_points", "debounce_sessions", "extract_symbols", "resolve_imports", "bm25_stored")


def project(spark: SparkSession, files: int = 1001, functions: int = 20) -> dict[str, float]:
    """A chain of Python files, each of which calls the one before: built, updated, indexed and asked."""
    import tempfile

    from orebody.api import Engine

    took: dict[str, float] = {}

    def timed(name: str, work) -> None:
        began = time.time()
        work()
        took[name] = round(time.time() - began, 3)

    with tempfile.TemporaryDirectory() as folder:
        root = Path(folder, "tree", "pkg")
        root.mkdir(parents=True)

        def write(i: int, more: str = "") -> None:
            first = f"from .m{i - 1} import fn_{i - 1}_0\n\n" if i else ""
            body = "".join(f"def fn_{i}_{j}(x):\n    return {f'fn_{i - 1}_0(x)' if i and j == functions - 1 else 'x + 1'}\n\n" for j in range(functions))
            Path(root, f"m{i}.py").write_text(first + body + more)

        for i in range(files):
            write(i)
        tree = str(root.parent)
        e = Engine(spark, f"file://{folder}/store", "bench")
        timed("project_graph_build", lambda: e.graph.build(tree))
        write(500, "def fn_new(x):\n    return fn_499_0(x)\n")
        timed("project_graph_update", lambda: e.graph.update(tree))
        timed("project_symbol_list", lambda: e.symbols.list("fn_500_5").collect())
        timed("project_impact", lambda: e.symbols.impact("fn_500_0", 3).collect())
        timed("project_index", lambda: e.index(tree))
        timed("project_search_100", lambda: e.search_many([f"fn_{i}_3 return" for i in range(100)]).collect())
    return took


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", "file:///tmp/checkpoints/bench")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from orebody import catalog

    queries = catalog.queries()
    spark.read.parquet(f"{sf}/documents.parquet").count()
    took = {}
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    took |= project(spark)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf).name}))


if __name__ == "__main__":
    main()
