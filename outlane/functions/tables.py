"""Series functions for SQL: a table function and array functions by name.

``install`` makes them known to a session::

    SELECT * FROM series_windows(TABLE(SELECT dataset, idx, values FROM series) PARTITION BY (dataset, idx), 16, 8)
    SELECT series_feature('z', values) FROM series

``register_array`` adds a function of the user's own before ``install``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: name -> function of an (n, length) matrix to an (n, width) matrix.
ARRAYS: dict[str, Callable[[np.ndarray], np.ndarray]] = {}


def register_array(name: str):
    """Make a matrix function known to ``series_feature`` by name."""
    def add(fn: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
        ARRAYS[name] = fn
        return fn
    return add


@register_array("z")
def _z(x: np.ndarray) -> np.ndarray:
    spread = x.std(axis=1, keepdims=True)
    return (x - x.mean(axis=1, keepdims=True)) / np.where(spread == 0, 1, spread)


@register_array("diff")
def _diff(x: np.ndarray) -> np.ndarray:
    return np.diff(x, axis=1, prepend=x[:, :1])


@register_array("range")
def _range(x: np.ndarray) -> np.ndarray:
    return np.stack([x.min(axis=1), x.max(axis=1)], axis=1)


class SeriesWindows:
    """Windows of each row's series: place, mean, deviation and slope.

    The table argument has columns dataset, idx and values; a null value or one
    shorter than a window has none.  With PARTITION BY the rows of a partition are
    read one after another and nothing is kept between them.
    """

    def eval(self, row, width: int, hop: int):
        values = row["values"]
        if values is None or len(values) < width:
            return
        windows = np.lib.stride_tricks.sliding_window_view(np.array(values, float), width)[::hop]
        t = np.arange(width) - (width - 1) / 2
        slopes = (windows - windows.mean(axis=1, keepdims=True)) @ t / (t @ t)
        for k, (w, slope) in enumerate(zip(windows, slopes)):
            yield row["dataset"], int(row["idx"]), k * hop, float(w.mean()), float(w.std()), float(slope)


def install(spark: SparkSession) -> None:
    """Register ``series_windows`` and ``series_feature`` in a session."""
    known = dict(ARRAYS)

    @F.pandas_udf("array<double>")
    def series_feature(name: pd.Series, values: pd.Series) -> pd.Series:
        out = [None] * len(values)
        size = values.map(lambda v: -1 if v is None else len(v)).to_numpy()
        for (which, length), where in pd.DataFrame({"name": name.to_numpy(), "length": size}).groupby(["name", "length"]).indices.items():
            if which not in known:
                raise ValueError(f"no array function is called {which}")
            if length > 0:
                for i, row in zip(where, known[which](np.stack(values.iloc[where].to_numpy()).astype(float))):
                    out[i] = row
        return pd.Series(out)

    spark.udf.register("series_feature", series_feature)
    spark.udtf.register("series_windows", F.udtf(SeriesWindows, returnType="dataset string, idx bigint, start int, mean double, deviation double, slope double"))
