"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

from formatpulse.plans.catalogue import CATALOGUE
from formatpulse.session import build_session

HEADLINE = (
    "adoption_growth_7d", "format_aggregates", "trend_scores", "score_breakdown_long",
    "latest_velocity", "velocity_growth_24h", "snapshot_backfill_14d", "filter_trends_combo",
    "facets", "totals", "corpus_join", "pending_items", "upgrade_queue", "creator_baseline",
    "trend_exemplars_topk", "saved_resolved", "upsert_items", "apply_changes",
    "feed_for_profiles", "in_niche", "token_counts", "format_signature", "hash_embed",
    "modal_sequence", "describe_trend", "slugs", "nearest_centroid", "pairs_above",
    "components", "format_clusters", "nightly_rebuild", "stream_velocity",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", **{
        "spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).groupBy("id").count().write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        begin = time.perf_counter()
        CATALOGUE[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": float(scale.group(1)) if scale else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
