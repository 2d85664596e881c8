"""Time every registered query and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores, ``BENCH_RUNS``
how often each query runs; its best time counts. Results are read in full but
not collected.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from lakeline.registry import QUERIES  # noqa: E402
from lakeline.session import build_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def main() -> None:
    spark = build_session(
        "lakeline-bench",
        master=f"local[{CPUS}]",
        settings={
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or list(QUERIES)
    best: dict[str, float] = {}
    for _ in range(RUNS):
        for name in names:
            start = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - start
            best[name] = min(spent, best.get(name, spent))
    spark.stop()
    result = {
        "metric": "total_query_seconds",
        "value": round(sum(best.values()), 3),
        "unit": "sec",
        "queries": {name: round(spent, 3) for name, spent in best.items()},
        "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": int(CPUS),
        "runs": RUNS,
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
