"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cadenza.session import local_session  # noqa: E402
from registry import all_queries  # noqa: E402

HEADLINE = [
    "listen_interactions", "coverage_stats", "catalog_build", "content_zscore", "cosine_topk", "content_topk",
    "item_neighbours", "cf_topk", "cooccurrence", "hybrid_topk", "candidate_dedup", "bucket_topk",
    "diversity_rerank", "playlist_sequence", "ranking_metrics", "benchmark_core",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=max(8, 2 * int(cpus)), app="bench")
    queries, seconds = all_queries(), {}
    spark.read.parquet(f"{sf_dir}/part.parquet").count()
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
                      "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions"))}))


main()
