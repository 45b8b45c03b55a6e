"""Time the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import time

from flowtally.plans.registered import all_queries
from flowtally.session import local_session

HEADLINE = """flow_feature_summary label_encode missing_profile row_missing_profile identical_columns dup_count
describe_features outlier_pct corr_matrix corr_matrix_wide kruskal levene anderson split_exact split_stratified
class_report macro_ovr detector_eval score_histogram drift_check latency_percentiles rolling_latency cve_extract
chunk_text chunk_upsert knn_topk knn_lsh rag_context retrieval_eval text_retrieval cve_sources token_pad model_report
tree_attribution pca_anomaly stream_request_metrics stream_last_n""".split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    queries, seconds = all_queries(), {}
    queries["label_share"](spark, folder).write.format("noop").mode("overwrite").save()  # start the workers
    for name in HEADLINE:
        t0 = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
