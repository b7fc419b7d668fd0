"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8)
choose the tables and the local cores. Every query runs to its end with the
``noop`` sink, so no column can be pruned away.
"""

from __future__ import annotations

import json
import os
import sys
import time

from finlake.plans.catalogue import QUERIES
from finlake.session import local_session

HEADLINE = (
    "agg10_rule_scorecard",
    "agg8_fraud_rate",
    "rul4_rul5_score_transactions",
    "win2_amount_screen",
    "win1_profit_vintiles",
    "agg5_profit_by_tenure",
    "drv3_silver",
    "agg13_gold_countries",
    "agg18_churn_profiles",
    "dq9_clean_transactions",
    "dq8_report",
    "win3_structuring",
    "win4_velocity",
    "win5_layering",
    "set3_rul8_rul9_run_rules",
    "que1_agg27_review_queue",
    "evl1_joi4_evaluate",
    "agg20_monthly_features",
    "win6_udf3_lags",
    "joi3_price_ratio",
    "srt2_topn_periods",
    "geo3_assign_cluster",
    "geo4_joi5_nearest_node",
    "gra2_shortest_paths",
    "txt1_chunk_recursive",
    "txt2_chunk_fixed",
    "vec1_joi6_knn",
    "win8_chat_context",
    "prf2_describe_all",
    "str1_str2_str4_str5_snk2_alert_stream",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in HEADLINE if not sys.argv[1:] or any(a in n for a in sys.argv[1:])]
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    QUERIES["agg8_fraud_rate"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
