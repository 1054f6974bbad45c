"""Times the headline queries; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from stringmill.plans.catalogue import QUERIES

HEADLINE = ("kmp_search", "bm_search", "naive_search", "rk_search", "suffix_search", "shiftor_exact", "chunked_search", "count_overlapping", "regex_nonoverlapping", "wildcard_search", "hamming_documents", "approx_documents", "edit_search_greedy", "contamination_join", "trace_kmp_documents", "algo_summary", "category_summary", "category_pivot", "speedup_vs_baseline")

#: Timed as well, but not in the total, so that it stays comparable.
MORE = ("multi_pattern_search", "multi_pattern_totals", "suffix_table_search", "suffix_tree_nodes", "fasta_round_trip", "bit_parallel_documents", "edit_search_greedy_documents", "edit_join_lines", "longest_common_substring_documents", "search_function", "speedup_by_algorithm")

#: Searches and the number of their patterns.
SEARCHES = tuple((n, 3) for n in ("kmp_search", "bm_search", "naive_search", "rk_search", "suffix_search", "shiftor_exact")) + tuple((n, 2) for n in ("hamming_documents", "approx_documents", "bit_parallel_documents", "edit_search_greedy_documents"))


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.files.maxPartitionBytes", "2m")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = dict(QUERIES)
    try:
        from stringmill.llm.queries import QUERIES as more

        queries |= more
    except ImportError:
        pass
    names = os.environ.get("BENCH_ONLY", "").split() or [*HEADLINE, *MORE, *(n for n in queries if n.startswith("op"))]
    QUERIES["kmp_search"](spark, sf).limit(1).collect()  # starts workers, compiles
    times = {}
    for name in names:
        began = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    out = {"metric": "total of headline queries", "value": round(sum(times.get(n, 0) for n in HEADLINE), 3), "unit": "sec", "queries": times, "sf": sf.rstrip("/").rpartition("/")[2].removeprefix("sf")}
    # Seconds a search: one pattern in one text, over all texts at once.
    out["seconds_per_search"] = {n: times[n] / (k * docs) for n, k in SEARCHES if n in times}
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
