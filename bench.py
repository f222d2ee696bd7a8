"""Times the headline queries; prints one JSON line.

Each query runs once to warm up and then three times; the median counts. Results are consumed by
Spark itself (a hash of all columns is summed), so nothing large reaches the driver. ``duckdb`` has the
time of the same query's SQL there, on as many threads, once warm.
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import time

import duckdb
from pyspark.sql import functions as F

from semdex.plans import registered
from semdex.session import local_session

HEADLINE = (
    "knn_topk", "knn_all_filters", "knn_multi_query", "simhash_bands", "lsh_candidates", "duplicates", "duplicates_cross_file",
    "line_windows_80_40", "line_windows_small", "merge_small_segments", "hash_embed", "file_diff", "repo_stats", "chunk_id_assign", "meta_upsert",
)


def duckdb_seconds(sf_dir: str, threads: int) -> dict[str, float]:
    con = duckdb.connect(config={"threads": threads})
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    took = {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            con.sql(registered.ORACLES[name]).fetchall()
            took[name] = round(time.perf_counter() - began, 3)
    return took


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench")
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            df = registered.QUERIES[name](spark, sf_dir)
            df.agg(F.sum(F.xxhash64(*df.columns) % 1000)).collect()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs[1:]), 3)
    duck = duckdb_seconds(sf_dir, int(os.environ.get("BENCH_CPUS", "8")))
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "duckdb": duck, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
