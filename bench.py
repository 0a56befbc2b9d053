"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR chooses the data, BENCH_CPUS the cores, and query names as arguments
choose the queries. Results go to a sink that discards them.
"""

from __future__ import annotations

import json
import os
import sys
import time

from catalogue.queries import ALL
from tidegauge.session import local_session

HEADLINES = [
    "prepare_features",
    "entity_key_frequency",
    "contract_check",
    "profile_summary",
    "drift_report",
    "batch_verdict",
    "flag_bh",
    "window_drift",
    "degradation_windows",
    "null_experiment",
    "scenario_backtest",
    "roc_auc_by_window",
    "rolling_prediction_mean",
    "stream_window_drift",
    "stream_score_log",
]


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.showConsoleProgress": "false"})
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds = {}
    for name in names or HEADLINES:
        started = time.perf_counter()
        ALL[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main(sys.argv[1:])
