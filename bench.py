"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

import json
import os
import sys
import time

HEADLINE = [
    "feed_page", "story_facts", "story_entities", "related_pairs", "coverage_timeline", "entity_bias_matrix",
    "content_fingerprint", "unknown_fingerprints", "significant_tokens", "cluster_texts", "low_value_verdicts",
    "page_articles", "ingest_funnel", "usage_hourly", "usage_breakdown", "counter_deltas", "app_runtime",
    "rolling_rate", "job_runs", "search_index", "search_stories", "search_many", "nearest_stories",
    "story_pair_similarity", "core_distances", "metadata_suspicion", "density_clusters", "story_matches",
    "usage_hourly_stream", "story_sessions", "merged_clusters", "indexed_neighbours",
]


def main():
    out = os.dup(1)
    os.dup2(2, 1)  # keep stdout clean for the one result line
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from pressweave.catalog import load_all
    from pressweave.session import get_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = get_session("bench", cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load_all()
    spark.read.parquet(f"{sf}/documents.parquet").selectExpr("max(length(text))").collect()  # start the executors
    times = {}
    for name in names:
        t = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    line = {"metric": "total_wall_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
            "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}
    os.write(out, (json.dumps(line) + "\n").encode())


if __name__ == "__main__":
    main()
