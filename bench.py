"""Headline queries over BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line, each query the median of its runs."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

from webtables import build_session  # noqa: E402
from webtables.plans import all_queries  # noqa: E402

HEADLINE = [
    "x14_r03_nav_links_ranked", "x01_shred_tag_counts", "x02_select_nav_links", "x09_path_select", "x14_extract_records",
    "x13_routed_records", "x14_field_forms", "x15_extract_many_sites", "x15_positions_and_urls", "x16_extract_toc", "x16_contents_over_pages", "x17_walk_pages", "x18_assemble_bodies", "x20_flatten_pages",
    "p10_clean_text", "p11_whitespace", "p12_format_paragraphs", "d01_decode_corpus", "d02_decode_quality",
    "d03_split_by_heading", "d04_split_by_chunk", "d05_split_documents", "d06_number_chapters", "d07_locate_positions",
    "s11_chapter_byte_index", "s07_upsert_registry", "a01_merge_hits", "a01_ordered_members", "a02_search_accounting",
    "a03_fold_health", "a05_health_classes", "r02_rank_offers", "r03_result_order", "r05_top_results", "r06_recent_items",
    "j04_next_alternative", "j05_fallback_body", "j06_map_position", "j07_dead_intervals", "a09_lint_rules",
    "a12_usability_funnel", "t01_merge_stream", "t02_health_stream",
]


#: Runs of each query; beyond the first ones they end after so many seconds.
RUNS, SECONDS = 3, float(os.environ.get("BENCH_SECONDS", "480"))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark_driver_memory=os.environ.get("BENCH_MEMORY", "16g"),
        spark_sql_shuffle_partitions=cpus, spark_ui_enabled="false", spark_ui_showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()

    def run(name: str) -> float:
        started = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        return time.time() - started

    run("x02_select_nav_links")  # warm the JVM and the Python workers
    started, seen = time.time(), {name: [] for name in HEADLINE}
    for _ in range(RUNS):
        for name in HEADLINE:
            if not seen[name] or time.time() - started < SECONDS:
                seen[name].append(run(name))
    times = {name: round(median(x), 3) for name, x in seen.items()}
    print(json.dumps({
        "metric": "headline queries, one warm session, median of the runs", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(sf).name.removeprefix("sf"),
        "runs": {name: len(x) for name, x in seen.items()},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
