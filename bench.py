"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Every query is run to
its last row into a sink that keeps nothing; a first, untimed query warms the session up.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from voxmill.session import build_session  # noqa: E402
from workload import all_queries  # noqa: E402

HEADLINE = (
    "rpt2_priority_matrix",
    "rpt3_summary",
    "rpt4_roadmap",
    "agg1_crosstab",
    "agg3_distributions",
    "top6_top_categories",
    "top3_issues",
    "top4_posts",
    "top5_topics_per_category",
    "set1_duplicate_texts",
    "join1_ledger_anti_join",
    "join2_attach_replies",
    "txt_clean_documents",
    "txt_clean_pages",
    "txt1_html",
    "prj6_nested_clean",
    "src4_issues",
    "src5_posts",
    "arr1_explode_items",
    "arr3_batches",
    "txt18_prompts",
    "cat1_user_classifier",
    "cat4_lexicon",
    "cat5_analyse_threads",
    "cat5_user_analyser",
    "snk1_append_threads",
    "snk5_resume",
    "src1_read_threads",
    "str1_collect_stream",
    "job_collect_issues",
    "job_feedback",
)


def run(query, spark, sf: str) -> float:
    start = time.perf_counter()
    query(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        app="bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    run(queries["agg12_threads_per_source"], spark, sf)
    seconds = {name: round(run(queries[name], spark, sf), 3) for name in names}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
