"""Benchmark the headline queries; prints ONE JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query runs to completion through the ``noop`` sink (every row computed,
nothing collected to the driver).  Every measured query first runs once on the
smallest tables, so JVM start-up, code generation and class loading are not
charged to the measured run.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wordloom.plans.queries import registry  # noqa: E402
from wordloom.session import ensure_checkpoint_dir, local_session  # noqa: E402

HEADLINE = [
    "preprocess_documents",
    "word_map",
    "normalization_stats",
    "normalized_tokens",
    "word_frequency",
    "frequent_oov",
    "oov_topk",
    "fuzzy_matches",
    "classification_report",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=max(8, 2 * int(cpus)), app="wordloom-bench")
    ensure_checkpoint_dir(spark)
    qs = registry()
    # warm-up: every measured plan once on the smallest tables (codegen, JIT, Python workers)
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    for name in names:
        run(qs[name](spark, warm_dir if os.path.isdir(warm_dir) else sf_dir))
    times = {}
    for name in names:
        t0 = time.perf_counter()
        run(qs[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total_headline_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
