"""Headline queries, timed.  Prints one JSON line.

BENCH_SF_DIR (default sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Each query runs three times, writing every result row to a sink that discards
it; the median counts, so a first run that compiles code and a run beside other
load do not.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = [
    "domain_article_counts", "domain_stats", "cited_domains", "article_sources", "article_counts",
    "topic_terms", "stopword_stats", "article_url_verdicts", "page_links", "page_titles",
    "page_tokens", "page_top_container", "page_body_text", "image_rank", "graph_merge",
    "frontier_depth2", "upsert_articles", "memo_anti_join",
]


def main() -> None:
    from pressgraph.registry import load_all
    from pressgraph.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, name="bench")
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_all()
    times = {}
    for name in HEADLINE:
        query = registry[name][0]
        runs = []
        for _ in range(3):
            start = time.time()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        times[name] = round(statistics.median(runs), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
