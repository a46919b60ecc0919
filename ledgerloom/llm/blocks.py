"""Exact comparison of all members of a part, block against block, without emitting pairs.

A part of any size is cut into blocks of bounded size. Every pair of blocks meets in one group,
which reports sums per member and a spanning forest of its links: at most one edge per member.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import grouped_rows, spanning_forest

_ARROW = pa.schema([("node", pa.binary()), ("other", pa.binary()), ("n", pa.int64())])
SCHEMA = "node binary, other binary, n long"


def compare_parts(
    members: DataFrame, linked: Callable[[list[bytes], list[bytes]], np.ndarray], rows_per_block: int
) -> DataFrame:
    """(node, other, n) of ``members`` (part, node, copies, payload), node unique.

    ``linked`` gives the boolean matrix of two lists of payloads. Rows without ``other`` hold
    copies linked to a node, one row per pair of blocks; the others are edges of the forest.
    """
    sizes = members.groupBy("part").agg(F.ceil(F.count("*") / rows_per_block).alias("_blocks")).filter("_blocks > 0")
    placed = members.join(sizes, "part").withColumn("_block", F.pmod(F.xxhash64("node"), F.col("_blocks")))
    placed = placed.withColumn("_with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    keys = ["part", "_lo", "_hi"]
    placed = placed.select(
        "part", F.least("_block", "_with").alias("_lo"), F.greatest("_block", "_with").alias("_hi"), "_block", "node", "copies", "payload"
    )
    placed = placed.repartition(*keys).sortWithinPartitions(*keys, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for (_, lo, hi), group in grouped_rows(batches, keys):
            left = [r for r in group if r["_block"] == lo]
            right = left if lo == hi else [r for r in group if r["_block"] == hi]
            if not right or len(group) < 2:
                continue
            matrix = linked([r["payload"] for r in left], [r["payload"] for r in right])
            if lo == hi:
                np.fill_diagonal(matrix, False)
            weight = np.array([r["copies"] for r in right], np.int64)
            counted = list(zip(left, (matrix @ weight).tolist()))
            if lo != hi:
                weight = np.array([r["copies"] for r in left], np.int64)
                counted += zip(right, (weight @ matrix).tolist())
            rows += [{"node": r["node"], "n": n} for r, n in counted if n]
            shift = 0 if lo == hi else len(left)
            pairs = ((int(i), int(j) + shift) for i, j in zip(*np.nonzero(matrix)))
            both = left if lo == hi else left + right
            rows += [{"node": both[i]["node"], "other": both[j]["node"]} for i, j in spanning_forest(len(both), pairs)]
            if len(rows) >= 5000:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return placed.mapInArrow(run, SCHEMA)
