"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

HEADLINE = ["search_ranked", "smart_and", "smart_phrase", "smart_not", "smart_filter_size_range", "exact_literal", "exact_batch", "regex_prefiltered", "filename_mode", "term_stats", "sort_modified", "diff_actions", "debounce_sessions", "html_text", "snippets"]


def percentile(times: list[float], p: float) -> float:
    """The time at index round((n - 1) * p) of the sorted times."""
    return sorted(times)[round((len(times) - 1) * p)]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 12g pyspark-shell")
    from quillon.catalogue import QUERIES
    from quillon.plans import index
    from quillon.plans.corpus import documents
    from quillon.session import local_session

    spark = local_session(cpus, int(cpus))
    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        began = time.time()
        run()
        times[name] = round(time.time() - began, 3)

    spark.range(1000).selectExpr("sum(id)").collect()  # the session's own start does not count
    for name in HEADLINE:
        timed(name, lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    where = tempfile.mkdtemp()
    docs = documents(spark, sf_dir)
    timed("index_build", lambda: index.write(docs, where))
    opened = index.Index.open(docs, where)
    for k, text in enumerate(("with", '"of the"', "with AND for", "with OR das", "with -for", "enth*")):
        timed(f"indexed_{k}", lambda: opened.matches(text).count())
    latency = []
    for _ in range(10):
        began = time.time()
        index.ranked(opened, "with OR for").collect()
        latency.append(time.time() - began)
    times["top10_warm_p50"], times["top10_warm_p95"] = round(percentile(latency, 0.5), 3), round(percentile(latency, 0.95), 3)
    size = docs.selectExpr("sum(size)").first()[0]
    shutil.rmtree(where)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "index_mb_s": round(size / 1e6 / times["index_build"], 2), "index_rows_s": round(docs.count() / times["index_build"], 1)}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
