"""Time headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tapeloom.plans.all_queries import QUERIES  # noqa: E402
from tapeloom.session import build_session  # noqa: E402

HEADLINE = (
    "flagship_latest_indicators", "f08_adjusted_bars", "f09_weekly_bars", "f03_normalise_factor", "i01_sma", "i12_indicators_daily",
    "b02_factor_scores", "b05_topn_weights", "c02_chip_series_full_grid", "p06_pe_series", "p07_pe_quantiles", "a04_decline_anchor",
    "x07_exhaustion_facts", "d04_falsification", "r02_right_side", "u04_accumulation", "e02_event_study", "e06_link_events",
    "e07_effective_state", "s24_parse_news", "s27_flow_block", "v04_batch_policy", "q05_signal_events", "q08_align", "t07_baseline_exit",
    "z01_surge_screen", "st3_tumbling_bars", "q01_stock_list", "q06_bars_daily", "q09_compare_metric", "q15_dashboard",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["f08_adjusted_bars"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start workers, warm the reader
    times: dict[str, float] = {}
    for name in HEADLINE:
        t = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "whole-universe recompute of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(os.environ.get("BENCH_CPUS", "8"))}))
    sys.stdout.flush()
    os._exit(0)


if __name__ == "__main__":
    main()
