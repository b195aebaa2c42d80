"""Headline queries, timed: one JSON line with the median of three runs after one warm-up.

Queries on training data, where they are there, run once each and do not count in the total.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from importlib.util import find_spec

from pyspark.sql import SparkSession

from tessera.plans.catalog import QUERIES

HEADLINE = ["q01_sections_lines", "q04b_row_numbers", "q05_identifiers", "q09_row_amounts", "q11_status_claims", "q18_date_edges", "q26_closest_section", "q27_quote_location", "q34_deadlines", "q40_numbers", "q47_packed_pieces"]

ONCE = ["op1_quality", "op2_jaccard_join", "op3_decontaminate", "op4_pack", "op5_url_filters", "op6_neighbours", "op7_html_text", "op8_shards", "op9_chat", "op10_remove_repeats", "op11_resample", "op12_toxicity", "op13_whiten"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "4")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="tessera-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            began = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(statistics.median(runs[1:]), 3)
    total = round(sum(took.values()), 3)
    if find_spec("tessera.llm"):
        from tessera.llm.queries import QUERIES as LLM

        for name in ONCE:
            began = time.time()
            LLM[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
        if find_spec("corpus_pipeline"):
            import corpus_pipeline

            began = time.time()
            corpus_pipeline.run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took["pipeline"] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total of headline queries", "value": total, "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
