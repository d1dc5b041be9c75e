"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the number of local cores.  The
store and the raw request bodies are written before the clock starts; every
query then runs twice to warm up and three times for its median.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog import configure
from emberlog.operators import aggregate as agg
from emberlog.operators import quality, search, series, stats, validation
from emberlog.plans import tables
from emberlog.plans.queries import NOON, SINCE, UNTIL
from emberlog.session import scratch
from emberlog.sources import envelopes as env
from emberlog.streaming.ingest import ingest_bodies

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
RUNS = 3


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("emberlog-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="emberlog-bench-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(run: Callable[[], None]) -> float:
    for _ in range(2):
        run()
    took = []
    for _ in range(RUNS):
        began = time.perf_counter()
        run()
        took.append(time.perf_counter() - began)
    return round(statistics.median(took), 3)


def main() -> None:
    spark = session()
    store = tables.main_store(spark, SF_DIR)
    store.rebuild_rollup("hour")
    store.rebuild_rollup("minute")
    bodies = tables.envelopes(spark, SF_DIR).select(F.col("body").alias("value"))
    path = scratch(spark, "bench-bodies")
    bodies.repartition(int(CPUS)).write.text(path)
    documents = tables.document_logs(spark, SF_DIR)

    def logs() -> DataFrame:
        return store.scan_logs()

    def validate() -> DataFrame:
        return validation.validate_entries(
            env.read_batches(spark, path), tables.AS_OF, retention_days=tables.RETENTION_DAYS
        )

    def ingest() -> None:
        fresh = tables.new_store(spark, "bench-ingest")
        bodies = env.read_bodies(spark, path)
        ingest_bodies(fresh, bodies, "bench", tables.AS_OF, keep_parsed=True)

    work: dict[str, Callable[[], None]] = {
        "raw_counts_message": lambda: drain(
            agg.bucket_counts(logs(), SINCE, UNTIL, "1h", q="closed")
        ),
        "raw_counts_by_service": lambda: drain(
            agg.bucket_counts(logs(), SINCE, UNTIL, "1m", "service")
        ),
        "rollup_counts_1h": lambda: drain(
            agg.rollup_counts(store.scan_partials("hour"), SINCE, UNTIL, "1h", "service")
        ),
        "aggregate_cut_range": lambda: drain(
            agg.aggregate(store, SINCE, UNTIL, "5m", "level")
        ),
        "search_newest": lambda: drain(search.search_store(store, service="switches", limit=100)),
        "search_message": lambda: drain(
            search.search_store(store, q="sensor", attr={"region": "coast"}, until=UNTIL)
        ),
        "search_documents": lambda: drain(search.search_logs(documents, q="ation", limit=100)),
        "validate": lambda: drain(validate()),
        "store_report": lambda: drain(stats.store_report(store, NOON)),
        "rollup_drift": lambda: drain(
            quality.rollup_drift(logs(), store.scan_partials("hour"), "hour")
        ),
        "dense_series": lambda: drain(
            series.dense_series(
                agg.aggregate(store, SINCE, UNTIL, "1h", "service"), SINCE, UNTIL, "1h", "service"
            )
        ),
        "ingest": ingest,
    }
    times = {name: timed(run) for name, run in work.items()}
    entries = env.read_batches(spark, path).count()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": SF_DIR.rsplit("sf", 1)[-1],
                "log_rows": logs().count(),
                "ingest_entries_per_sec": round(entries / times["ingest"]),
            }
        )
    )


if __name__ == "__main__":
    main()
