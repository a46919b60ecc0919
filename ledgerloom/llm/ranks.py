"""Exact positions of rows in groups of any size, for the training-data operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import materialize

ROWS_PER_PIECE = 50_000


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str], position: str, total: str | None = None) -> DataFrame:
    """Add the 0-based ``position`` of each row of a stored table in its group by ``order``, and
    the ``total`` of rows of the group.

    Rows are range-partitioned by group and order, so that a group spans as many pieces as its
    rows need; a window numbers the rows of a piece and the small piece totals give the offsets.
    ``group`` columns are not NULL; in ``order`` NULL comes first. Rows equal in all these columns
    get the positions in any order.
    """
    pieces = max(1, -(-df.count() // ROWS_PER_PIECE))
    placed = df.repartitionByRange(pieces, *group, *order).withColumn("_piece", F.spark_partition_id())
    placed = materialize(placed, "ranked")
    sizes = placed.groupBy("_piece", *group).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_piece", *group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    if total:
        sums = sizes.groupBy(*group).agg(F.sum("_n").alias(total))
        offsets = offsets.join(sums, list(group)) if group else offsets.crossJoin(sums)
    inside = Window.partitionBy("_piece", *group).orderBy(*order)
    rows = placed.withColumn(position, F.row_number().over(inside)).join(offsets, ["_piece", *group])
    return rows.withColumn(position, (F.col(position) - 1 + F.col("_before")).cast("long")).drop("_piece", "_before")
