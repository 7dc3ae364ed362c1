"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from mixframe.plans import all_queries
from mixframe.session import build_session

HEADLINE = [
    "cues_from_durations", "write_tracklists", "insert_gaps_from_segments", "mark_false_unknowns", "release_cues",
    "infer_hours", "match_tracks_exact", "match_tracks_fuzzy", "lookup_entities", "entity_family", "player_usage",
    "date_candidates", "episodes_from_titles", "learn_conventions", "siblings_around", "duplicate_candidates",
    "mirror_usage", "category_plan", "score_runs", "scan_links", "union_sources", "track_fields",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": os.environ.get("BENCH_CHECKPOINTS") or tempfile.mkdtemp(prefix="checkpoints-")})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/orders.parquet").count()  # start the workers before the clock
    queries, times = all_queries(), {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": folder.rstrip("/").split("sf")[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
