"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) names the tables and
``BENCH_CPUS`` (default 8) the cores. Each query runs once to warm the JVM and the
Python workers, then is timed; all rows are computed, none are collected.
"""

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from checks.queries import QUERIES  # noqa: E402

HEADLINE = [
    "chunk_documents",
    "chunk_pages",
    "embed_hash",
    "index_documents_rows",
    "corpus_roundtrip",
    "corpus_stats",
    "run_stats",
    "exclude_reason",
    "knn_single",
    "knn_filtered",
    "knn_batch",
    "knn_batch_blocks",
    "rag_query",
    "render_human",
    "render_machine",
]


def run(spark: SparkSession, name: str, sf_dir: str) -> float:
    began = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        run(spark, name, sf_dir)
        seconds[name] = round(run(spark, name, sf_dir), 3)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    chunks = QUERIES["row_count"](spark, sf_dir).head()["rows"]
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": int(cpus),
                "documents": documents,
                "chunks": chunks,
                "rates": {
                    "chunked_documents_per_sec": round(documents / seconds["chunk_documents"], 1),
                    "chunks_per_sec": round(chunks / seconds["chunk_documents"], 1),
                    "indexed_documents_per_sec": round(documents / seconds["index_documents_rows"], 1),
                },
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
