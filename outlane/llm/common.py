"""Shared pieces: written intermediate results and connected components."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlane.session import checkpoint_dir

#: Folders written by :func:`written` in this process and not yet removed, and
#: the owner of each; see :func:`owned`.
_FOLDERS: dict[str, str | None] = {}
_OWNER: list[str | None] = [None]


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and read it back.

    This cuts lineage: a lost executor costs a re-read of shared files.  The
    reader prunes columns and knows the true size, so Spark and AQE choose
    broadcasts by measured bytes.
    """
    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark)}/outlane-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    _FOLDERS[folder] = _OWNER[-1]
    return spark.read.schema(df.schema).parquet(folder)


def remove(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the folders behind frames returned by :func:`written`."""
    for frame in frames:
        for folder in list(_FOLDERS):
            if any(folder.rpartition("/")[2] in name for name in frame.inputFiles()):
                _delete(spark, folder)


@contextmanager
def owned(owner: str, frame: DataFrame):
    """What is written inside belongs to ``owner``.

    For a chain of steps whose results are written and read again: once a step
    starts from the reread ``frame``, what earlier steps of the same owner have
    staged and ``frame`` does not read is garbage, and deleted.  Folders of others
    stay.
    """
    mine = [folder for folder, of in _FOLDERS.items() if of == owner]
    names = frame.inputFiles() if mine else []
    for folder in mine:
        if not any(folder.rpartition("/")[2] in name for name in names):
            _delete(frame.sparkSession, folder)
    _OWNER.append(owner)
    try:
        yield
    finally:
        _OWNER.pop()


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    del _FOLDERS[folder]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that is not the least of its component.

    ``edges`` has long columns ``a`` and ``b``.  Nodes without a row are their
    own component.  Large-star and small-star rounds rewrite the edge set until
    each node points at the least node of its component; rows stay distributed,
    every round is written out, and a hub is one aggregated row on the small
    side of a join whose large side AQE may split.  No edges give no rows.
    """
    spark = edges.sparkSession
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    seal = _seal(now)
    while seal[0]:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (large.join(root, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                 .unionAll(root.select("hi", F.col("m").alias("lo"))).distinct())
        after = written(small)
        remove(spark, now)
        now, before = after, seal
        seal = _seal(now)
        if seal == before:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))


def _seal(edges: DataFrame) -> tuple:
    one = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return one[0], one[1]
