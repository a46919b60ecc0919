"""Row positions and running sums inside groups of any size.

A plain window puts a whole group into one task. Here rows are range-partitioned by (group, key),
so a group is cut into as many pieces as its size needs. Sums inside a piece come from a window
over that piece, and the sums of earlier pieces come from the small piece totals. Results are
exact for any choice of range bounds; the bounds only balance the work. The number of pieces
follows the rows; a single piece has no earlier ones, so its window is the result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import materialize, materialize_pieces

ROWS_PER_PIECE = 100_000


def pieces_of(rows: int, rows_per_piece: int = ROWS_PER_PIECE) -> int:
    """Number of range partitions: rows over the row target, at least one, no upper bound."""
    return max(1, -(-rows // rows_per_piece))


def ordered_prefix(
    df: DataFrame,
    group: Sequence[str],
    key: str,
    sums: Mapping[str, Column] | None = None,
    position: str = "position",
    pieces: int | None = None,
    store: bool = True,
    ties: Sequence[str] = (),
    bucketed: bool = False,
) -> DataFrame:
    """Add the 0-based ``position`` of each row in its group by ``key``, and for each entry of
    ``sums`` the total over the earlier rows of the group (NULL if there are none).

    ``group`` columns and ``key`` are not NULL; rows of one key are ordered by ``ties``. Rows of
    one (group, key) share a piece, so a key must not repeat without bound. The rows are read
    several times and so stored first; ``store=False`` leaves that out for a stored table.
    ``bucketed=True`` stores the pieces as a table in buckets of them, whose windows send no row again.
    """
    sums = dict(sums or {})
    df = materialize(df, "ordered") if store else df
    n = pieces or pieces_of(df.count())
    valued = df.withColumns(sums) if sums else df
    if n == 1:
        return _numbered(valued, group, key, sums, position, ties)
    # Range bounds come from a sample; the stored piece number stays the same if a task is retried.
    placed = valued.repartitionByRange(n, *group, key).withColumn("_piece", F.spark_partition_id())
    placed = materialize_pieces(placed, "_piece", n) if bucketed else materialize(placed, "pieces")

    totals = placed.groupBy(*group, "_piece").agg(F.count("*").alias("_n"), *(F.sum(s).alias(f"_{s}") for s in sums))
    before = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group,
        "_piece",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"),
        *(F.sum(f"_{s}").over(before).alias(f"_{s}") for s in sums),
    )
    work = _numbered(placed, [*group, "_piece"], key, sums, position, ties).join(offsets, [*group, "_piece"])
    moved = {position: (F.col(position) + F.col("_n")).cast("long")}
    for s in sums:
        inner, outer = F.col(s), F.col(f"_{s}")
        moved[s] = F.when(inner.isNull(), outer).otherwise(inner + F.coalesce(outer, F.lit(0)))
    return work.withColumns(moved).drop("_piece", "_n", *(f"_{s}" for s in sums))


def _numbered(
    df: DataFrame, group: Sequence[str], key: str, sums: Mapping[str, Column], position: str, ties: Sequence[str]
) -> DataFrame:
    """Position and sums over the earlier rows, by a plain window."""
    inside = Window.partitionBy(*group).orderBy(key, *ties)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    numbered = {position: (F.row_number().over(inside) - 1).cast("long")}
    return df.withColumns(numbered | {s: F.sum(s).over(earlier) for s in sums})
