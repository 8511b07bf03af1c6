"""Time the headline queries; prints one JSON line.

Every query is run to its end without collecting rows (a write to the ``noop``
sink), once to warm up and then ``BENCH_RUNS`` times; the best time counts.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tocsin.plans import inputs
from tocsin.plans.queries import registered
from tocsin.session import build_session

HEADLINES = [
    "log_lines",
    "severity_tags",
    "crash_anchor",
    "context_window",
    "preprocess_lines",
    "preprocess_array",
    "validate_requests",
    "gov_deny",
    "gov_decision",
    "gov_summary",
    "parse_answers",
    "first_valid_attempt",
    "agent_chain",
    "prompt_diagnostic",
    "report_all",
    "escalations",
    "metric_counts",
    "metric_percentiles",
    "metric_percentiles_global",
]

# Queries whose main input is the documents table; the others read events.
ON_DOCUMENTS = {
    "log_lines",
    "severity_tags",
    "preprocess_array",
    "validate_requests",
    "prompt_diagnostic",
    "report_all",
    "escalations",
}


def spread_copy(spark, folder: str, files: int) -> str:
    """The tables as a cluster would store them: a file of one row group is a single task."""
    copy = tempfile.mkdtemp(prefix="bench-input-")
    for name in ("documents", "events", "conversations"):
        rows = inputs.table(spark, folder, name)
        rows.repartition(files).write.parquet(f"{copy}/{name}.parquet")
    return copy


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINES
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="12g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spread = spread_copy(spark, folder, int(cpus))
    rows = {t: inputs.table(spark, spread, t).count() for t in ("documents", "events")}
    seconds, rates = {}, {}
    for name in names:
        best = None
        for _ in range(runs + 1):
            start = time.perf_counter()
            registered()[name](spark, spread).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
        source = "documents" if name in ON_DOCUMENTS else "events"
        rates[name] = round(rows[source] / best)
    print(
        json.dumps(
            {
                "metric": "headline queries, total of best times",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "input_rows": rows,
                "input_rows_per_sec": rates,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
