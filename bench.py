"""Times the headline queries on one machine and prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores. The session is warmed on the smallest
scale next to the tables, which is not timed. Stored inputs are timed on their own, under the
name of the step that builds them, before the queries that read them.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from worksift.plans.storage import drop_run  # noqa: E402
from worksift.queries import catalog  # noqa: E402

# Built once and read by many: works, rule scores, the graph, described texts and their features.
STORED = {
    "build_works": lambda spark, d: catalog.works(spark, d),
    "build_scored": lambda spark, d: catalog.scored(spark, d),
    "build_merged": lambda spark, d: catalog.merged(spark, d),
    "build_graph": lambda spark, d: catalog.graph(spark, d)[3],
    "build_texts": lambda spark, d: catalog.texts(spark, d, "lang", "source"),
    "build_text_features": lambda spark, d: catalog.text_space(spark, d)[1],
}
HEADLINE = (
    "payment_rollup",
    "peer_groups",
    "agency_concentration",
    "score_all",
    "graph_edges",
    "vendor_concentration",
    "alias_candidates",
    "identical_batches",
    "near_copy_pairs",
    "district_near_copy_pairs",
    "outcome_accept",
    "outcome_context",
    "works_page",
    "works_search",
    "works_facets",
    "summary_figures",
    "pendency_kinds",
    "pendency_groups",
    "delay_model",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("worksift-bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="worksift-bench-"))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(build, where: str) -> float:
        start = time.perf_counter()
        build(spark, where).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    steps = {**STORED, **{name: catalog.QUERIES[name] for name in HEADLINE}}
    small = str(Path(sf_dir).parent / "sf0.001")
    if os.path.isdir(small) and small != sf_dir:
        for build in steps.values():
            run(build, small)
    times = {name: run(build, sf_dir) for name, build in steps.items()}
    print(
        json.dumps(
            {
                "metric": "total seconds, all headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    drop_run(spark)
    spark.stop()


if __name__ == "__main__":
    main()
