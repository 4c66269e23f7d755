"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from quarterglass.plans.audit_run import SecondSource, run_audit  # noqa: E402
from quarterglass.session import local_session  # noqa: E402
from quarterglass.sources import trade_panel as TP  # noqa: E402
from workload.queries import REGISTRY  # noqa: E402

HEADLINE = (
    "scan_typed", "panel_load", "sequence_info", "rolling_slope", "membership", "expand_members", "coverage_by_quarter",
    "returns_clean", "trend_features", "research_panel", "sample_flow", "sample_flow_by_quarter", "quarters_per_firm",
    "signal_funnel", "missing_reasons", "missing_by_sector", "duplicates_report", "feature_summary", "ties_by_quarter",
    "precision_audit", "filing_lag_summary", "formula_checks", "formula_checks_exact", "return_alignment", "crosscheck",
    "catalogue", "text_clean", "wacc_chain", "rule_battery", "ytd_to_quarter", "quality_flags",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", driver_memory="16g")
    spark.sparkContext.setLogLevel("OFF")
    REGISTRY["sequence_info"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm the JVM
    seconds = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name:28s} {seconds[name]:8.3f}", file=sys.stderr, flush=True)
    start = time.perf_counter()
    second = SecondSource(TP.price_sheet(spark, sf_dir), TP.full_precision(spark, sf_dir))
    with tempfile.TemporaryDirectory(prefix="spark-", dir="/tmp") as out:
        run_audit(spark, TP.panel(spark, sf_dir), TP.ranges(spark, sf_dir), out, second=second)
    seconds["audit_run"] = round(time.perf_counter() - start, 3)
    print(f"{'audit_run':28s} {seconds['audit_run']:8.3f}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "panel_audit_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
