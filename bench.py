"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line with seconds by query.

Every query runs once cold, which compiles its code, and then warm: BENCH_RUNS times, or until that took BENCH_SECONDS, once at
least. What counts is the median of the warm runs; the cold ones are given beside them.
"""

import importlib
import json
import os
import re
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = "catalog_count catalog_page bm25_topk bigram_topk dense_topk rrf_fuse facet_cover path_bundles graph_one_hop graph_two_hop two_hop_templates identity_bridges graph_audit_full multiset_prf gold_containment_hits citation_verify paragraphs queue_claim idempotent_first rate_limit_first_event publish_tasks events_sessions chunk_tokens".split()


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    runs, seconds = int(os.environ.get("BENCH_RUNS", "3")), float(os.environ.get("BENCH_SECONDS", "8"))
    from quillspark.session import session

    shared = tempfile.mkdtemp(prefix="bench-")  # one machine, so its own folder is shared
    spark = session("bench", f"local[{cpus}]", **{"spark.driver.memory": "8g", "spark.sql.shuffle.partitions": cpus, "spark.checkpoint.dir": shared, "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = importlib.import_module("__spark_entry__").queries()
    cold: dict[str, float] = {}
    warm: dict[str, float] = {}
    for name in [n for n in [*HEADLINE, *[n for n in queries if re.match(r"op\d+_", n)], "pipeline"] if n in queries]:
        each: list[float] = []
        while len(each) < 2 or len(each) <= runs and sum(each[1:]) < seconds:
            began = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            each.append(time.perf_counter() - began)
        cold[name], warm[name] = round(each[0], 3), round(statistics.median(each[1:]), 3)
    print(json.dumps({"metric": "total of median warm seconds", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "cold": cold, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
