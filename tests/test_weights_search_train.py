"""Density weights need the neighbours of TRAIN rows only."""

from outlane.operators import scoring
from outlane.plans.registry import QUERIES


def test_only_train_rows_search(tables, monkeypatch):
    seen, search = [], scoring.neighbours
    monkeypatch.setattr(scoring, "neighbours", lambda rows, *a, **k: seen.append(rows) or search(rows, *a, **k))
    assert QUERIES["density_weights"](tables).count() == tables.archive().filter("split = 'TRAIN'").count()
    assert [{r.split for r in rows.select("split").distinct().collect()} for rows in seen] == [{"TRAIN"}]
