"""Runtime settings and shared storage used by every job."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime SQL settings the library relies on. Skewed shuffle partitions are split by the
# adaptive engine even where the split costs a further exchange: one key may hold a large
# share of all rows.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    # Files are far smaller than their rows in the memory of the driver and of each executor, by which a
    # broadcast is bounded: ordered ids take one byte in the file and some 80 there. What was shuffled is measured as it is.
    "spark.sql.sources.fileCompressionFactor": "100",
    # A join by (order, seller) takes rows dealt by order as they are.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


ROWS_PER_BUCKET = 200_000
BROADCAST_ROWS = 500_000

# Stores named stage results and returns them in their stored form.
Keep = Callable[[Mapping[str, DataFrame]], dict[str, DataFrame]]


def configure(spark: SparkSession) -> SparkSession:
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back to a new temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by the cluster")
    folder = tempfile.mkdtemp(prefix="run-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a stage result to shared storage and read it back.

    Used where a stage has several consumers: it is computed once, its lineage is cut, and a
    lost executor costs no recomputation.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_all(frames: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Materialize independent stage results as concurrent jobs."""
    with ThreadPoolExecutor(len(frames)) as pool:
        return dict(zip(frames, pool.map(lambda name: materialize(frames[name], name), frames), strict=True))


def small(df: DataFrame) -> DataFrame:
    """The frame, to be broadcast if its counted rows are within a fixed bound; best for a stored table.

    The engine guesses a join's size as a product and learns it only after the other side was shuffled.
    """
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def buckets_of(rows: int) -> int:
    """Number of buckets: rows over the row target, at least one, no upper bound."""
    return max(1, -(-rows // ROWS_PER_BUCKET))


def materialize_by(key: str, buckets: int) -> Keep:
    """Like ``materialize_all``, but frames with the column ``key`` are stored as bucketed tables of it.

    Grouping and joining such tables by the key, or by more columns with it, needs no exchange. All
    tables of one pipeline share the number of buckets. Rows of one key are read by one task; they lie
    together in the file, which takes less space.
    """

    def stored(df: DataFrame, label: str) -> DataFrame:
        if key not in df.columns:
            return materialize(df, label)
        name = f"{label}_{uuid.uuid4().hex}"
        writer = df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key)
        writer.option("path", new_folder(df.sparkSession, label)).saveAsTable(name)
        return df.sparkSession.table(name)

    def keep(frames: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        with ThreadPoolExecutor(len(frames)) as pool:
            return dict(zip(frames, pool.map(lambda label: stored(frames[label], label), frames), strict=True))

    return keep


def materialize_pieces(df: DataFrame, piece: str, pieces: int) -> DataFrame:
    """Like ``materialize``, for rows whose tasks hold one value of ``piece`` each: stored in buckets of it, one file per
    task, so that grouping by it and more columns needs no exchange."""
    name = f"pieces_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").bucketBy(pieces, piece)
    writer.option("path", new_folder(df.sparkSession, "pieces")).saveAsTable(name)
    return df.sparkSession.table(name)


def unstored(frames: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Keep nothing: stages stay part of one plan."""
    return dict(frames)
