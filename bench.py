"""Time the headline queries; prints one JSON line.

Each query runs once to warm up (JVM code generation, Python workers) and then ``BENCH_RUNS`` times;
the best run counts. Rows go to a sink that drops them, so every column is computed and nothing is
written or collected.
"""

from __future__ import annotations

import json
import os
import time

from corpus_spark.plans import tables
from corpus_spark.plans.catalogue import QUERIES
from corpus_spark.session import build_session

HEADLINE = (
    "clean_source",
    "clean_summary",
    "clean_parallel",
    "nfc_normalize",
    "postprocess",
    "collapse_repeats",
    "word_counts",
    "document_split",
    "source_split",
    "row_split",
    "threshold_split",
    "chat_records",
    "length_batches",
    "translate_validation",
    "submission_by_key",
    "submission_by_position",
    "bleu_tokens",
    "corpus_bleu",
    "corpus_chrf",
    "evaluate",
    "evaluate_by_turn",
    "document_bleu",
    "evaluate_documents",
    "best_run",
)


def timed(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.driver.memory": "16g",
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # The bench's tables are one row group each, which would be one task.
    tables.DEAL = int(cpus)
    seconds = {}
    for name in HEADLINE:
        timed(lambda: QUERIES[name](spark, folder))
        seconds[name] = round(min(timed(lambda: QUERIES[name](spark, folder)) for _ in range(runs)), 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
