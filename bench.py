"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR   folder of the tables (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores (default 8)
    BENCH_QUERIES  'all' or a comma-separated list (default: the headline ones)

Each query runs to completion into a sink that drops the rows. Stage tables
that several queries share are built first and reported on their own line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import registry  # noqa: E402
from walksieve.session import local_session  # noqa: E402

HEADLINE = (
    "select", "select_fixed", "greedy_dedup", "calibrated_tau", "far_pairs", "far_sketch",
    "similarity_edges", "reference_pairs", "heading_ratio", "reselect", "requantile",
    "legibility_gate", "pano_index", "frame_decimation", "stitch_completeness", "sample_panos",
    "recording_catalogue", "sharpness", "face_projection", "class_shares", "mask_boundaries",
    "decision_replay", "validate_decisions", "effective_picks", "walk_list", "stage_counts",
    "stage_durations", "run_history", "meta_upsert", "rerun_plan", "export_manifest",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(registry.QUERIES) if asked == "all" else asked.split(",") if asked else list(HEADLINE)
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "walksieve-bench")
    spark.sparkContext.setLogLevel("ERROR")

    def timed(work) -> float:
        start = time.perf_counter()
        work()
        return round(time.perf_counter() - start, 3)

    run = lambda name: registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    # start the Python workers and compile the first stages outside the clock
    run("sharpness")
    stages = timed(lambda: registry.manifest(spark, sf_dir))
    seconds = {name: timed(lambda name=name: run(name)) for name in names}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "stage_tables_sec": stages, "cold_total_sec": round(sum(seconds.values()) + stages, 3), "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
