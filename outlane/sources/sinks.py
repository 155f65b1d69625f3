"""Result sinks, their digests, and the checks that guard a frozen result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_rows(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("append").format(fmt).option("header", "true").save(path)


def union_results(*frames: DataFrame) -> DataFrame:
    """Stack result tables whose columns differ."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON object per row, keys sorted."""
    return df.select(row_json(df).alias("value"))


def row_json(df: DataFrame, columns: list[str] | None = None) -> Column:
    return F.to_json(F.struct(*sorted(columns or df.columns)))


def write_jsonl(df: DataFrame, path: str) -> None:
    json_lines(df).write.mode("overwrite").text(path)


def read_jsonl(spark, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Hash of a row that does not depend on column order."""
    return F.sha2(row_json(df, columns), 256)


def table_digest(df: DataFrame) -> DataFrame:
    """Row count and order-free digest: the sum of 48-bit row hash prefixes."""
    part = F.conv(F.substring(row_hash(df), 1, 12), 16, 10).cast("decimal(20,0)")
    return df.select(part.alias("h")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("h").cast("string").alias("digest"))


def verify_digest(df: DataFrame, manifest: DataFrame) -> DataFrame:
    """Raise when a frozen table no longer matches its manifest row."""
    both = table_digest(df).withColumn("k", F.lit(1)).join(
        manifest.select(F.col("digest").alias("frozen"), F.lit(1).alias("k")), "k")
    return both.filter(F.assert_true(F.col("digest") == F.col("frozen"), F.lit("frozen result changed")).isNull())
