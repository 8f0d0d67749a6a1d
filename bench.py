"""Times every query beside its SQL in DuckDB and prints one JSON line.

Each query runs once to warm up and then up to five times; the median counts. Results go
to the noop sink, so that all rows and columns are computed; DuckDB's go to a table, once
after a warm-up. Every query is timed once before any is timed again, and no round is
begun that would not end within BENCH_SECONDS. BENCH_SF_DIR and BENCH_CPUS name the data
and the cores, BENCH_QUERIES the queries.
"""

from __future__ import annotations

import json
import os
import statistics
import time
from collections.abc import Callable
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from nearfield.plans.oracle import SQL
from nearfield.plans.queries import QUERIES

# SQL that takes longer than this is not run a second time.
SLOW_SQL = 2.0


def seconds(work: Callable[[], object]) -> float:
    start = time.perf_counter()
    work()
    return time.perf_counter() - start


def main() -> None:
    begun = time.perf_counter()
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    budget = float(os.environ.get("BENCH_SECONDS", "700"))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("nearfield-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ.get("BENCH_QUERIES")
    chosen = names.split(",") if names else list(QUERIES)

    def run(name: str) -> float:
        return seconds(lambda: QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save())

    for name in chosen:
        run(name)
    times: dict[str, list[float]] = {name: [] for name in chosen}
    for _ in range(runs):
        start = time.perf_counter()
        for name in chosen:
            times[name].append(run(name))
        now = time.perf_counter()
        if now - begun + (now - start) > budget:
            break
    median = {name: round(statistics.median(t), 3) for name, t in times.items()}
    done = len(times[chosen[0]])
    spark.stop()

    db = duckdb.connect(config={"threads": int(cores)})
    for file in sorted(Path(sf).glob("*.parquet")):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    sql = {}
    for name in chosen:
        work = f"CREATE OR REPLACE TEMP TABLE result AS {SQL[name]}"
        spent = seconds(lambda: db.execute(work))
        sql[name] = round(spent if spent > SLOW_SQL else seconds(lambda: db.execute(work)), 3)
    print(
        json.dumps(
            {
                "metric": "total of median query times",
                "value": round(sum(median.values()), 3),
                "unit": "sec",
                "queries": median,
                "duckdb": sql,
                "ratio": {name: round(median[name] / max(sql[name], 0.001), 2) for name in chosen},
                "runs": done,
                "sf": sf.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
