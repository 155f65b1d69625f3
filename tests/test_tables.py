"""Series functions called from SQL."""

import numpy as np
import pytest

from outlane.functions import tables


def test_own_functions_are_known_to_sql(spark, monkeypatch):
    monkeypatch.setattr(tables, "ARRAYS", dict(tables.ARRAYS))

    @tables.register_array("ends")
    def ends(x):
        return np.stack([x[:, 0], x[:, -1]], axis=1)

    tables.install(spark)
    rows = spark.createDataFrame([("d", 1, [1.0, 2.0, 4.0]), ("d", 2, [5.0]), ("e", 3, None), ("e", 4, [])], "dataset string, idx bigint, values array<double>")
    rows.createOrReplaceTempView("some_series")
    got = {r.idx: (r.a, r.b) for r in spark.sql("SELECT idx, series_feature('ends', values) AS a, series_feature('diff', values) AS b FROM some_series").collect()}
    assert got == {1: ([1.0, 4.0], [0.0, 1.0, 2.0]), 2: ([5.0, 5.0], [0.0]), 3: (None, None), 4: (None, None)}
    windows = spark.sql("SELECT * FROM series_windows(TABLE(some_series) PARTITION BY (dataset, idx), 2, 1)").collect()
    assert sorted((r.idx, r.start, r.mean, r.slope) for r in windows) == [(1, 0, 1.5, 1.0), (1, 1, 3.0, 2.0)]
    with pytest.raises(Exception, match="no array function is called nothing"):
        spark.sql("SELECT series_feature('nothing', values) FROM some_series").collect()
