"""Exact order statistics that survive a hot group.

A plain window puts a whole group into one task.  That is right for groups of
ordinary size and fatal when one dataset holds a third of all rows.  Every
operator here first asks whether such a group exists; only then it takes the
split path: choose split points from a hash-selected subset of the group's own
keys, number the rows inside each split, and add the sizes of the splits before
it.  The split points only balance the work - every row is numbered, and the
numbers are the same on both paths: NULL and NaN stand where Spark's own
ascending and descending orders put them, and NULL values keep their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS_CONF = "outlane.hotGroupRows"
HOT_ROWS_DEFAULT = 2_000_000
SMALL_INPUT_BYTES = 8 * 1024 * 1024
SPLITS = 256
POINTS_PER_SPLIT = 32


def hot_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(HOT_ROWS_CONF, str(HOT_ROWS_DEFAULT)))


def has_hot_group(df: DataFrame, keys: list[str]) -> bool:
    """True when some group is larger than one task should hold.

    The question costs a job, left out when little is scanned: the plain path
    gives the same rows, so a wrong guess about very small files costs time only.
    """
    limit = hot_rows(df)
    if limit >= HOT_ROWS_DEFAULT and _scanned_bytes(df) <= SMALL_INPUT_BYTES:
        return False
    return not df.groupBy(*keys).count().filter(F.col("count") > limit).isEmpty()


def _scanned_bytes(df: DataFrame) -> float:
    """Estimated size of everything the plan scans.

    Behind a checkpoint the estimate is that of its plan, which multiplies at every
    join; numbers of more digits than Python reads are infinite.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    try:
        return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    except ValueError:
        return float("inf")


def _sort_key(df: DataFrame, order: list[tuple[str, str]]) -> Column:
    """One struct whose ascending order is the asked order.

    Each column becomes (flag, value): the flag puts NULL first and NaN last for
    ascending columns and the other way round for descending ones.
    """
    fields = []
    for i, (c, direction) in enumerate(order):
        value, floating = F.col(c), df.schema[c].dataType.typeName() in ("double", "float")
        nan = F.isnan(value) if floating else F.lit(False)
        null, odd = (0, 2) if direction == "asc" else (2, 0)
        flag = F.when(value.isNull(), null).when(nan, odd).otherwise(1)
        plain = value if direction == "asc" else -value
        fields += [flag.alias(f"f{i}"), (F.when(~nan, plain) if floating else plain).alias(f"k{i}")]
    return F.struct(*fields)


def _splits(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per hot group, a bounded sorted list of split points of ``_k``."""
    limit = hot_rows(df)
    wanted = SPLITS * POINTS_PER_SPLIT
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / wanted)).cast("long")
    points = (df.select(*keys, "_k").join(sizes, keys)
              .filter(F.pmod(F.xxhash64("_k"), step) == 0)
              .groupBy(*keys).agg(F.sort_array(F.collect_list("_k")).alias("_points")))
    thin = F.greatest(F.lit(1), F.ceil(F.size("_points") / SPLITS)).cast("int")
    return points.select(*keys, F.filter("_points", lambda _, i: i % thin == 0).alias("_bounds"))


def with_position(df: DataFrame, keys: list[str], order: list[tuple[str, str]], name: str = "rn",
                  running: dict[str, Column] | None = None) -> DataFrame:
    """Add the 1-based position of each row inside its group.

    ``order`` is a list of (column, "asc"/"desc"); its last column must be
    unique in the group.  Descending columns must be numeric.  ``running`` adds
    inclusive running sums in the same order.
    """
    running = running or {}
    sort_cols = [F.col(c).desc() if d == "desc" else F.col(c).asc() for c, d in order]
    if not has_hot_group(df, keys):
        window = Window.partitionBy(*keys).orderBy(*sort_cols)
        frame = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = df.withColumn(name, F.row_number().over(window).cast("long"))
        for label, value in running.items():
            out = out.withColumn(label, F.sum(value).over(frame))
        return out
    keyed = df.withColumn("_k", _sort_key(df, order))
    for label, value in running.items():
        keyed = keyed.withColumn(label, value)
    bounded = keyed.join(_splits(keyed, keys), keys, "left")
    in_split = bounded.withColumn(
        "_split", F.coalesce(F.size(F.filter("_bounds", lambda b: b < F.col("_k"))), F.lit(0))).drop("_bounds")
    in_split = in_split.withColumn("_split", F.greatest("_split", F.lit(0)))
    part = keys + ["_split"]
    totals = in_split.groupBy(*part).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(v).alias(f"_t_{v}") for v in running])
    before = Window.partitionBy(*keys).orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *part, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_b_{v}") for v in running])
    window = Window.partitionBy(*part).orderBy("_k")
    frame = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = in_split.withColumn(name, F.row_number().over(window).cast("long"))
    for label in running:
        out = out.withColumn(label, F.sum(label).over(frame))
    out = out.join(offsets, part).withColumn(name, F.col(name) + F.col("_before"))
    for label in running:
        out = out.withColumn(label, F.col(label) + F.col(f"_b_{label}"))
    return out.drop("_k", "_split", "_before", *[f"_b_{v}" for v in running])


def with_cumulative(df: DataFrame, keys: list[str], value: str, sums: dict[str, Column],
                    descending: bool = False) -> DataFrame:
    """Add tie-inclusive running sums over ``value``.

    Equal values share one result.  On the split path equal values are summed
    before they are shuffled, so a heavy tie is one row.
    """
    if not has_hot_group(df, keys):
        order = F.col(value).desc() if descending else F.col(value).asc()
        window = Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        out = df
        for label, weight in sums.items():
            out = out.withColumn(label, F.sum(weight).over(window))
        return out
    steps = df.groupBy(*keys, value).agg(*[F.sum(w).alias(f"_s_{n}") for n, w in sums.items()])
    direction = "desc" if descending else "asc"
    steps = with_position(steps, keys, [(value, direction)], "_p", {n: F.col(f"_s_{n}") for n in sums})
    found = steps.select(*[F.col(c).alias(f"_j{i}") for i, c in enumerate([*keys, value])], *sums)
    same = [F.col(c).eqNullSafe(F.col(f"_j{i}")) for i, c in enumerate([*keys, value])]
    return df.join(found, same).drop(*[f"_j{i}" for i in range(len(keys) + 1)])


def exact_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float],
                    weight: str | None = None, hot: bool | None = None) -> DataFrame:
    """Linear (exact) quantiles per group, one row per group.

    ``weight`` is an integer column: a row counts that many times.  ``hot`` answers
    ``has_hot_group`` for a caller that knows.
    """
    times = F.col(weight) if weight else F.lit(1)
    if not (has_hot_group(df, keys) if hot is None else hot):
        qs = {n: F.percentile(value, F.lit(float(q)), times) for n, q in quantiles.items()}
        return df.groupBy(*keys).agg(*[q.alias(n) for n, q in qs.items()])
    clean = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), times.alias("_w"))
    steps = clean.groupBy(*keys, "_v").agg(F.sum("_w").alias("_c"))
    steps = with_position(steps, keys, [("_v", "asc")], "_p", {"_upto": F.col("_c")})
    sizes = clean.groupBy(*keys).agg(F.sum("_w").alias("_n"))
    placed = steps.join(sizes, keys)
    aggs = []
    for n, q in quantiles.items():
        pos = (F.col("_n") - 1) * F.lit(float(q))
        for tag, target in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            holds = (F.col("_upto") > target) & (F.col("_upto") - F.col("_c") <= target)
            aggs.append(F.max(F.when(holds, F.col("_v"))).alias(f"_{tag}_{n}"))
        aggs.append(F.max(pos - F.floor(pos)).alias(f"_f_{n}"))
    got = placed.groupBy(*keys).agg(*aggs)
    return got.select(*keys, *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
                               for n in quantiles])
