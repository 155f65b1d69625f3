"""Time the headline queries and print one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from outlane.plans import load_all  # noqa: E402
from outlane.plans.registry import QUERIES  # noqa: E402
from outlane.session import local_session  # noqa: E402
from outlane.sources.tables import Tables  # noqa: E402

HEADLINE = [
    "one_class_archive", "label_windows_join", "exact_content_dedup", "knn_local_gap_report", "rocket_features", "multi_pool_features",
    "spectral_bands", "interval_quantile_features", "gasf_image", "hog_texture", "lof_crossfit", "threshold_rule_sweep", "peaks_over_threshold",
    "kde_threshold", "train_reference_rank", "p_value_fusion", "score_combination_family", "agreement_strategy_sets", "rank_fusion_top_k",
    "weak_alert_replacement", "lane_routing", "auc_roc", "auc_pr", "config_summary", "progress_log_parse", "online_ema_threshold"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "outlane-bench")
    load_all()
    Tables(spark, folder).table("events").count()
    seconds = {}
    for name in HEADLINE:
        begin = time.time()
        QUERIES[name](Tables(spark, folder)).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - begin, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(folder).replace("sf", "")}))
    spark.stop()


if __name__ == "__main__":
    main()
