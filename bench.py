"""Times the headline queries at BENCH_SF_DIR on local[BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from lodechain.plans import registry
from lodechain.session import local_session

HEADLINE = [
    "behaviour_groups", "interval_join", "shared_artifact_groups", "merge_same_anchor", "bursts", "collapse_runs", "round_robin_cap", "windowed_rerank",
    "catalogue_topk_all", "technique_distribution_all", "family_boost_all", "bm25", "viterbi_chain", "sequence_lcs", "detection_rules", "knn_anomaly_all", "lineage_walk", "provenance_edges", "group_sets", "auc_by_type",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    spark = local_session(cpus)
    times: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):  # the first run compiles code
            began = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(min(runs), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
