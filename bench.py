"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], and their SQL in DuckDB on as many threads; prints one JSON line.

Each figure is the median of three runs in a row. The same queries over the next
smaller tables, if they are there, tell start-up from work.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from statistics import median

import duckdb

from strandline.plans.queries import QUERIES, SQL
from strandline.session import local_session

HEADLINE = ["semantic_topk", "semantic_topk_filtered", "keyword_search", "hybrid_search", "rerank_mock", "chunk_text", "sentence_split", "detect_changes", "index_status", "upsert_files", "cache_probe", "embed_batches", "find_files_all", "recent_searches"]
RUNS = 3
SMALLER = {"sf0.1": "sf0.01", "sf0.01": "sf0.001"}


def timed(run: Callable[[str], object]) -> dict[str, float]:
    """Seconds of each headline query."""

    def once(name: str) -> float:
        began = time.time()
        run(name)
        return time.time() - began

    return {name: round(median(once(name) for _ in range(RUNS)), 3) for name in HEADLINE}


def duckdb_times(sf_dir: str, cpus: int) -> dict[str, float]:
    db = duckdb.connect(config={"threads": cpus})
    for file in sorted(os.listdir(sf_dir)):
        if file.endswith(".parquet"):
            db.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM read_parquet('{sf_dir}/{file}')")
    return timed(lambda name: db.execute(SQL[name]).fetchall())


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("OFF")
    over = lambda folder: lambda name: QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    over(sf_dir)("upsert_files")  # starts the engine; not counted
    took = timed(over(sf_dir))
    sf = os.path.basename(sf_dir)
    smaller = os.path.join(os.path.dirname(sf_dir), SMALLER.get(sf, "-"))
    more = {f"queries_{SMALLER[sf]}": timed(over(smaller))} if os.path.isdir(smaller) else {}
    print(json.dumps({"metric": "headline queries, total of medians of three", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf, "duckdb": duckdb_times(sf_dir, cpus)} | more))
    spark.stop()


if __name__ == "__main__":
    main()
