"""Time the headline queries and print one JSON line.

BENCH_SF_DIR  folder of the parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS    cores of the local session (default all)
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from docflow.plans import QUERIES  # noqa: E402
from docflow.session import local_session  # noqa: E402

HEADLINE = (
    "script_census", "transliterate_corpus", "cyr_to_lat", "run_transliteration", "segments_to_runs",
    "request_rules", "missing_languages", "release_accept", "archive_summary", "path_safety", "unique_names",
    "plan_resolve", "range_pages", "merge_sequence", "distinct_ci", "cell_types", "base_fanout", "clean_corpus",
    "build_lines", "page_metrics", "paragraph_build", "words_to_columns", "slide_chunks", "complete_cells",
    "style_chain", "outline_numbers", "gaussian_smooth", "active_duration", "session_state", "frame_integrity",
    "frame_reassembly", "traffic_windows",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    keys = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench")
    QUERIES["script_census"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for key in keys:
        start = time.perf_counter()
        QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[key] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, whole tables", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
