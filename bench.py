"""Time the headline queries; prints one JSON line. Each query runs from its tables, nothing shared in between."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ruleloom.plans import catalog
from ruleloom.session import local_session

HEADLINE = [
    "dictionary",
    "bag_sample",
    "item_gain",
    "rules_support",
    "rules_support_baskets",
    "rules_gain",
    "rules_gain_bags",
    "coverage_lines",
    "first_match",
    "proba_mean",
    "ensemble_predict",
    "cv_summary",
    "roc",
    "ensemble_training",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_CPUS", "8")), "ruleloom-bench")
    # One small query first, so that the start of the session is not charged to the first headline query.
    catalog.QUERIES["header_summary"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        catalog.clear_shared()
        start = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(folder.rstrip("/"))
    print(json.dumps({"metric": "total query time", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))


if __name__ == "__main__":
    main()
