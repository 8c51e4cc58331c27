"""Time the headline queries. Prints one JSON line.

``BENCH_SF_DIR`` names the tables (default /root/testdata/sf0.1), ``BENCH_CPUS``
the cores (default 8), ``BENCH_RUNS`` the timed runs per query (default 3, after
one warm-up; the median counts).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from codecat.operators import gomod, java, npm, python_env  # noqa: E402
from codecat.operators.digest import digest  # noqa: E402
from codecat.plans import catalogue as store  # noqa: E402
from codecat.plans import search as find  # noqa: E402
from codecat.plans.postings import open_postings  # noqa: E402
from codecat.sources.corpus import read_corpus  # noqa: E402
from codecat.sources.locations import open_locations, update_locations  # noqa: E402
from codecat.sources.scratch import scratch_dir, staged  # noqa: E402
from codecat.workload import fixture  # noqa: E402
from codecat.workload.queries import queries  # noqa: E402


def consume(df: DataFrame) -> None:
    """Compute all rows and drop them."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    # A stored corpus, its digest and its catalogue, as a user would have them.
    home = scratch_dir(spark, "bench")
    fixture.files(spark, sf_dir).repartition(int(cpus)).write.parquet(f"{home}/corpus")
    corpus = read_corpus(spark, f"{home}/corpus")
    facts = staged(digest(corpus), "digest", "kind")
    store.index(corpus, f"{home}/catalogue")
    store.build_postings(spark, f"{home}/catalogue")
    catalogue = store.open_catalogue(spark, f"{home}/catalogue")
    postings = open_postings(spark, f"{home}/catalogue")
    update_locations(spark, f"{home}/corpus", f"{home}/locations", f"{home}/checkpoint")
    locations = open_locations(spark, f"{home}/locations")
    registered = queries()

    timed = {
        "digest": lambda: consume(digest(corpus)),
        "java_symbols": lambda: consume(java.java_symbols(facts)),
        "python_modules": lambda: consume(python_env.python_modules(facts)),
        "npm_modules": lambda: consume(npm.npm_modules(facts)),
        "go_files": lambda: consume(gomod.go_files(facts)),
        "build_catalogue": lambda: consume(store.build_catalogue(corpus)[0]),
        "index": lambda: store.index(corpus, scratch_dir(spark, "catalogue")),
        "search_fuzzy": lambda: consume(find.search(catalogue, "doc 1 c")),
        "search_exact": lambda: consume(find.search(catalogue, "example.com/m0/f3.go", exact=True)),
        "search_lang": lambda: consume(find.search(catalogue, "pkg m", language="python")),
        "search_listing": lambda: consume(find.search_listing(catalogue)),
        "resolve_name": lambda: consume(find.resolve_name(catalogue)),
        "lookup_content": lambda: consume(
            find.lookup_located(find.search(catalogue, "f 1"), locations)
        ),
        "search_batch": lambda: consume(
            find.search_batch(catalogue, fixture.name_queries(spark, sf_dir), postings)
        ),
        "expand_archives": lambda: consume(registered["expand_archives"](spark, sf_dir)),
        **{
            name: lambda name=name: consume(registered[name](spark, sf_dir))
            for name in ("maven_artifacts", "new_artifacts", "jdk_archive", "index_upsert", "incremental_index", "index_archives", "tree_files")
        },
    }
    seconds = {}
    for name, run in timed.items():
        run()
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            run()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
    spark.stop()
    result = {
        "metric": "catalogue queries, median seconds summed",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(os.path.basename(sf_dir).removeprefix("sf")),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
