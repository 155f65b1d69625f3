"""A cross-section of the registered queries against their SQL twins."""

import math

import duckdb
import pytest

from conftest import FOLDER
from outlane.plans import load_all
from outlane.plans.registry import ORACLES, QUERIES
from outlane.sources.tables import Tables

load_all()
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["one_class_archive", "label_windows_join", "train_test_overlap_removal", "balanced_two_percent", "local_gap_knn", "robust_deviation_topk",
          "threshold_rule_sweep", "peaks_over_threshold", "kde_threshold", "family_pooled_own_weight", "train_reference_rank_nan_safe", "p_value_fusion",
          "source_reliability", "agreement_strategy_sets", "largest_tail_gap", "weak_alert_replacement", "lane_routing", "auc_pr", "best_k_f1",
          "lane_metrics", "progress_log_parse", "interpolate_missing", "train_robust_scale", "multi_pool_features", "spectral_derivative_profile",
          "shapelet_distance", "hog_texture", "lof_crossfit", "online_ema_threshold", "frozen_conformal_scoring",
          "kmeans_crossfit", "tolerance_match", "pca_projection", "periodicity_detrended", "strategy_table_selections", "config_sweep", "sql_series_functions"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return repr(float(v)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, duck, name):
    ours = QUERIES[name](Tables(spark, FOLDER)).toPandas()
    theirs = duck.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    cols = sorted(ours.columns)
    table = lambda df: sorted(tuple(canon(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))
    assert table(ours) == table(theirs)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
