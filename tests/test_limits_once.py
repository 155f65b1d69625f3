"""Thresholds and exceed rates of all sources are made one time per query."""

from outlane.operators import thresholds
from outlane.plans.registry import QUERIES


def test_feature_source_review_makes_limits_once(tables, monkeypatch):
    made, cap = [], thresholds.count_cap
    monkeypatch.setattr(thresholds, "count_cap", lambda *a, **k: made.append(1) or cap(*a, **k))
    QUERIES["feature_source_review"](tables).count()
    assert len(made) == 1
