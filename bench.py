"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default sf0.1) names the tables, BENCH_CPUS the cores, BENCH_QUERIES a comma list.
Every query runs once to warm up and then BENCH_RUNS times; the median counts.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import time

from evidentia.plans.catalog import registered
from evidentia.session import local_session

HEADLINE = [
    "iqr_discretize", "cut_discretize", "causal_select", "nmi_relevance", "nmi_select", "bic_family_scores", "bdeu_cpt",
    "bn_lambda", "bn_structure", "lof_rows", "outlier_predict", "bn_anomaly", "ts_anomaly", "synthetic_sample", "oversample_rows", "error_rank_consistency", "gmm_nodes", "gmm_chosen", "lof_wide", "markov_blanket_tests", "synthetic_sample_large", "ts_anomaly_states",
    "ace_two", "placebo_effect", "scm_ablation",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    queries, _ = registered()
    spark = local_session(cpus, "evidentia-bench")
    seconds = {}
    for name in names:
        took = []
        for i in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                took.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(took), 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(sf.group(1)) if sf else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
