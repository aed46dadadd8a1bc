"""Headline queries at one scale factor; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from vigilgrid.catalog import load
from vigilgrid.session import local_session

HEADLINE = [
    "events_hourly", "detections_daily", "camera_health", "traffic_heatmap", "latency_profile", "object_trends",
    "reranked_hits", "hybrid_search", "query_intents", "query_time_ranges", "vector_top_k", "gallery_matches",
    "zero_shot_labels", "close_people", "overlapping_people", "suppressed_boxes", "proximity_components",
    "linked_by_overlap", "labelled_detections", "zone_members", "zone_dwell_islands", "accelerations", "track_lifecycles",
    "suppressed_alerts", "loitering_alerts", "camera_legs", "distinct_frames", "change_audit", "attribute_report",
    "live_events_hourly", "live_suppressed_alerts"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    entries = load()
    entries["events_hourly"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        started = time.perf_counter()
        entries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
