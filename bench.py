"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line. Each query is run in full into a sink that discards the rows;
``*_per_sec`` is the rate over whole rows of the input table.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from limpida.plans.queries import QUERIES  # noqa: E402
from limpida.session import local_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = (
    "documents",
    "canonical_text",
    "removed_sections",
    "pii_merged",
    "redact_documents",
    "page_text",
    "merged_bodies",
    "message_bodies",
    "redacted_headers",
    "first_per_body",
    "pii_report",
    "latency_report",
    "spikes",
)
RATES = {"documents": "documents", "redact_documents": "documents", "page_text": "pages"}


def main() -> None:
    spark = local_session(CPUS, "16g")
    rows = {t: spark.read.parquet(f"{SF_DIR}/{t}.parquet").count() for t in set(RATES.values())}
    # Start the Python workers and the code caches before the clock runs.
    QUERIES["documents"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    rates = {f"{q}_per_sec": round(rows[t] / seconds[q], 1) for q, t in RATES.items()}
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(SF_DIR).name,
                "cpus": int(CPUS),
                **rates,
            }
        )
    )


if __name__ == "__main__":
    main()
