"""Leakage, plan shape and source/sink checks."""

import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from conftest import FOLDER
from outlane.operators import fusion, scoring, thresholds
from outlane.plans.scoring import vectors
from outlane.sources import archive, sinks


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_import_needs_no_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 200"
    subprocess.run([sys.executable, "-c", code], check=True, cwd="/root/repo", timeout=120)


def test_no_label_in_scoring_plans(tables):
    rows = vectors(tables)
    assert "y" not in rows.columns
    assert " y#" not in plan(scoring.centroid_scores(rows))


def test_native_operators_use_no_python(tables):
    scores = tables.scores()
    for df in (thresholds.sweep(scores.filter("split = 'TRAIN'"), ["dataset", "source"]), fusion.conformal_p(scores, ["dataset", "source"])):
        assert "Python" not in executed(df) and "Pandas" not in executed(df)


def test_scan_is_pruned(tables):
    text = executed(tables.truth().groupBy("dataset").agg(F.sum("y")))
    assert "ReadSchema" in text and "props" not in text.split("ReadSchema")[1]


def test_top_k_is_pruned_before_the_shuffle(tables):
    from outlane.operators.reports import strategy_detail
    from outlane.plans.selection import detail
    assert "WindowGroupLimit" in executed(strategy_detail(detail(tables)))


def test_text_archive_round_trip(spark, tmp_path):
    (tmp_path / "a.ts").write_text("# c\n@seriesLength 3\n@missing true\n@data\n1.0,?,3.5:2\n4,5:1\n")
    got = {r.label: r["values"] for r in archive.read_archive(spark, str(tmp_path)).collect()}
    assert got["1"] == [4.0, 5.0] and got["2"][0] == 1.0 and got["2"][1] != got["2"][1]


def test_jsonl_round_trip_and_digest(spark, tables, tmp_path):
    rows = tables.truth().select("dataset", "idx", "y")
    path = str(tmp_path / "p")
    sinks.write_jsonl(rows, path)
    again = sinks.read_jsonl(spark, path, "dataset string, idx bigint, y int")
    frozen = sinks.table_digest(rows)
    assert sinks.verify_digest(again, frozen).count() == 1
    with pytest.raises(Exception, match="frozen result changed"):
        sinks.verify_digest(again.filter("idx > 0"), frozen).collect()
    sinks.append_rows(rows, str(tmp_path / "out"))
    sinks.append_rows(rows, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2 * rows.count()


def test_flagship_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() == 10
    assert FOLDER.endswith("sf0.001")
