"""A table stored in the order of its key, for paged reading.

The order is found once. Rows of ``rows_per_zone`` consecutive positions share a folder, and a
small index holds each zone's rows and key range. A page knows its positions and so its zones; it
opens one or two of them, however deep it lies and however large the table is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.ordered import ordered_prefix

ROWS_PER_ZONE = 100_000


@dataclass(frozen=True)
class PagedTable:
    spark: SparkSession
    folder: str
    schema: T.StructType
    key: str
    rows_per_zone: int

    def zones(self) -> DataFrame:
        """(zone, rows, first_key, last_key) of each zone."""
        return self.spark.read.parquet(f"{self.folder}/index")

    def _open(self, zones: list[int]) -> DataFrame:
        stored = T.StructType([*self.schema.fields, T.StructField("_at", T.LongType())])
        if not zones:
            return self.spark.createDataFrame([], stored)
        return self.spark.read.schema(stored).parquet(*(f"{self.folder}/rows/_zone={z}" for z in zones))

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """Rows ``offset`` to ``offset + limit - 1`` in key order; fewer at the end of the table."""
        first, last = offset // self.rows_per_zone, (offset + limit - 1) // self.rows_per_zone
        there = self.zones().filter(F.col("zone").between(first, last)).select("zone").collect()
        rows = self._open(sorted(r[0] for r in there))
        return rows.filter(F.col("_at").between(offset, offset + limit - 1)).orderBy("_at").drop("_at")

    def after(self, key: str | None, limit: int) -> DataFrame:
        """The next rows behind a key (None: from the start), without counting the rows before."""
        index = self.zones().filter("rows > 0")
        index = index if key is None else index.filter(F.col("last_key") > F.lit(key))
        zones = [(r["zone"], r["rows"]) for r in index.orderBy("zone").limit(1 - -limit // self.rows_per_zone).collect()]
        rows = self._open([z for z, _ in zones])
        rows = rows if key is None else rows.filter(F.col(self.key) > F.lit(key))
        return rows.orderBy("_at").limit(limit).drop("_at")


def store_pages(df: DataFrame, key: str, folder: str, rows_per_zone: int = ROWS_PER_ZONE) -> PagedTable:
    """Store a table with a unique, not NULL text key for paged reading."""
    placed = ordered_prefix(df, [], key, position="_at").withColumn("_zone", F.expr(f"_at div {rows_per_zone}").cast("int"))
    # Sorted files: the position filter of a page reaches their row groups.
    placed.repartition("_zone").sortWithinPartitions("_zone", "_at").write.partitionBy("_zone").parquet(f"{folder}/rows")
    stored = T.StructType([*df.schema.fields, T.StructField("_at", T.LongType()), T.StructField("_zone", T.IntegerType())])
    zones = df.sparkSession.read.schema(stored).parquet(f"{folder}/rows").groupBy(F.col("_zone").alias("zone")).agg(
        F.count("*").alias("rows"), F.min(key).alias("first_key"), F.max(key).alias("last_key")
    )
    zones.coalesce(1).write.parquet(f"{folder}/index")
    return PagedTable(df.sparkSession, folder, df.schema, key, rows_per_zone)
