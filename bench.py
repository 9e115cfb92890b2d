"""Headline queries at one scale factor; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from ledgerloom.registry import QUERIES
from ledgerloom.session import drop_intermediates, local_session
from ledgerloom.sources.driver_tables import DriverTables

HEADLINE = [
    "join_buy_sell", "pipe_pairs", "pipe_club_scores", "pipe_full_analytics", "pipe_league_tiers", "join_asof_club_profit",
    "join_self_swapped_loans", "win_lag_breaks", "agg_health_score", "pipe_consistency", "pipe_features", "pipe_reconcile_once",
    "set_incremental_transfers", "agg_gem_leagues", "fn_classify_transfer", "src_csv_transfers", "stream_ingest",
    "stream_dedup", "stream_reconcile", "join_fuzzy_player", "pipe_shots", "pipe_xg",
]


def timed(build) -> float:
    start = time.time()
    build().write.format("noop").mode("overwrite").save()
    return round(time.time() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    shared = os.environ.get("BENCH_SHARED_DIR", os.path.join(os.getcwd(), "spark-warehouse", "shared"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), **{"spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": shared})
    spark.sparkContext.setLogLevel("ERROR")
    tables = DriverTables(spark, folder)
    tables.raw("region").count()
    seconds = {"build_ledger": timed(tables.build_transfers)}
    # the derived ledgers are stored once here; the queries below scan them
    seconds["store_ledgers"] = timed(lambda: tables.paired)
    for name in names:
        seconds[name] = timed(lambda: QUERIES[name](spark, folder))
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": float(scale.group(1)) if scale else folder}), flush=True)
    drop_intermediates(spark)
    spark.stop()


if __name__ == "__main__":
    main()
