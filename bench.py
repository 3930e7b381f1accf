"""Headline timings: each query end to end from the raw tables, one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from panelcast import session
from panelcast.registry import REGISTRY

HEADLINE = """assemble_panel all_features window_targets event_skill lead_metrics log_mean_ensemble seed_band_by_series
conformal_report normalisation_drift wind_statistics window_summary split_statistics manifest event_balanced_batches
lag_ridge six_baselines audit_metrics readiness_verdict model_scoring bootstrap_interval""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = session.build("panelcast-bench", session.default_master(), int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    REGISTRY["fire_flag"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM up
    took = {}
    for n in names:
        t = time.perf_counter()
        REGISTRY[n].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[n] = round(time.perf_counter() - t, 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": float(sf.group(1)) if sf else None}))


if __name__ == "__main__":
    main()
