"""The given tables, and the series, scores and labels assembled from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlane.functions.columns import r6
from outlane.functions.order import with_position
from outlane.session import stage
from outlane.sources.archive import one_class

SOURCES = ("rocket", "image_a", "image_b", "multi")


class Tables:
    """Lazy access to one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._staged: dict[str, DataFrame] = {}

    def once(self, name: str, build) -> DataFrame:
        """A stage contract: build a result with several readers one time."""
        if name not in self._staged:
            self._staged[name] = stage(build())
        return self._staged[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # -- labelled archive -> one-class datasets --------------------------------
    def labelled(self) -> DataFrame:
        return self.table("embeddings").select(
            F.lit("emb").alias("archive"), F.col("vec_id").alias("id"),
            F.col("label").cast("string").alias("cls"), F.col("embedding").cast("array<double>").alias("values"))

    def archive(self) -> DataFrame:
        """(dataset, split, idx, id, y, values): the one-class construction.

        Written out once per use of the tables; every query below reads it more
        than once.
        """
        return self.once("archive", lambda: one_class(self.labelled()))

    def series(self) -> DataFrame:
        """The archive without labels."""
        return self.archive().drop("y")

    def scored_series(self) -> DataFrame:
        """All TRAIN and TEST rows, without labels."""
        return self.series()

    # -- timestamped events -> scores ------------------------------------------
    def event_rows(self) -> DataFrame:
        """TRAIN (normal only) and TEST rows per user, with a dense index."""
        events = self.table("events").select(
            "event_id", F.concat(F.lit("u"), "user_id").alias("dataset"),
            F.concat(F.lit("f"), F.pmod("user_id", F.lit(7)).cast("string")).alias("family"), "ts", "value",
            F.get_json_object("props", "$.k").cast("double").alias("k"),
            (F.col("event_type") == "error").cast("int").alias("y"),
            F.when(F.col("ts") < "2024-01-20", "TRAIN").otherwise("TEST").alias("split"))
        kept = events.filter((F.col("split") == "TEST") | (F.col("y") == 0))
        placed = with_position(kept, ["dataset", "split"], [("event_id", "asc")], "idx")
        return placed.withColumn("idx", F.col("idx") - 1)

    def scores(self) -> DataFrame:
        """(dataset, family, split, idx, source, score) for four sources."""
        rows = self.event_rows()
        pairs = F.array(*[F.struct(F.lit(n).alias("source"), e.alias("score")) for n, e in self._scores().items()])
        return (rows.select("dataset", "family", "split", "idx", F.explode(pairs).alias("p"))
                .select("dataset", "family", "split", "idx", "p.source", "p.score"))

    @staticmethod
    def _scores() -> dict:
        """The score of each source as a column of ``event_rows``."""
        return {"rocket": F.col("value"), "image_a": F.col("k"), "image_b": r6(F.col("value") * F.col("k") / 100),
                "multi": r6(F.abs(F.col("value") - 50) + F.col("k") / 10)}

    def score(self, source: str = "rocket") -> DataFrame:
        return self.event_rows().select("dataset", "family", "split", "idx", self._scores()[source].alias("score"))

    def score_once(self, source: str = "rocket") -> DataFrame:
        """The scores of one source for operators that read them several times."""
        return self.once(f"score {source}", lambda: self.score(source))

    def truth(self) -> DataFrame:
        """TEST labels; only evaluation reads this."""
        return self.event_rows().filter(F.col("split") == "TEST").select("dataset", "family", "idx", "y")

    # -- line items -> ragged monthly panels -----------------------------------
    def panel(self) -> DataFrame:
        """Monthly quantity per supplier; months without sales are missing."""
        lines = self.table("lineitem").select(
            "l_suppkey", F.trunc("l_shipdate", "month").alias("month"), "l_quantity")
        monthly = lines.groupBy("l_suppkey", "month").agg(F.sum("l_quantity").alias("v"))
        series = monthly.groupBy("l_suppkey").agg(
            F.sort_array(F.collect_list(F.struct("month", "v"))).alias("points"))
        nations = self.table("supplier").join(
            self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "n_regionkey")
        return (series.join(nations, F.col("l_suppkey") == F.col("s_suppkey"))
                .select(F.col("n_name").alias("dataset"), F.col("l_suppkey").alias("idx"),
                        F.col("n_regionkey").alias("region"), F.col("points.v").alias("values")))
