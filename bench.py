"""Headline timings: prints one JSON line.

The first query runs once to warm up the session; each query then runs QUIRE_BENCH_RUNS times (default 1) and the median is
reported. The sink is ``noop``, so results are computed in full and not stored.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from quire.plans import registry
from quire.session import local_session

HEADLINE = [
    "classify_blocks", "pack_chunks", "stage_counts", "validate_documents", "draft_elements", "build_elements", "normalize_heading_levels",
    "index_boxes", "best_page", "head_tail_match", "section_summaries", "regenerate_overviews", "translation_batches", "merge_translations",
    "apply_edits", "invalidate_paragraph_highlights", "non_overlapping", "segments",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("QUIRE_BENCH_RUNS", "1"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="quire-bench", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = registry.load()
    wanted = os.environ.get("QUIRE_BENCH_QUERIES")
    seconds = {}
    for name in wanted.split(",") if wanted else HEADLINE:
        times = []
        for _ in range(runs + (1 if not seconds else 0)):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[-runs:]), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
