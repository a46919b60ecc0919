"""Repeated payloads in a stream, removed by keyed state that expires.

A client that sends a payload again, with the same content, adds nothing. The content's digest is
kept in the state store until the watermark has passed its time, so the state holds the digests
of one retention interval and not of the whole stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def on_disk_state(spark: SparkSession) -> SparkSession:
    """Keep state of streams on disk instead of on the heap, with changes alone uploaded per batch."""
    spark.conf.set(_STATE_STORE, _ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return spark


def content_digest(payloads: DataFrame, time: str = "ingested_at") -> Column:
    """Digest of all columns but the time of arrival; NULL and absent parts count as equal."""
    return F.sha2(F.to_json(F.struct(*(c for c in payloads.columns if c != time))), 256)


def without_retries(payloads: DataFrame, within: str = "14 days", time: str = "ingested_at") -> DataFrame:
    """The first payload of each content among those that arrive ``within`` an interval.

    On a stream, a payload older than the watermark is late and left out, and so is one without
    a time. On a table, equal contents count once whatever their times, and the earliest stays;
    the two agree where retries come within the interval and payloads in order of time.
    """
    marked = payloads.withColumn("_digest", content_digest(payloads, time))
    if not payloads.isStreaming:
        best = marked.filter(F.col(time).isNotNull()).groupBy("_digest").agg(
            F.min_by(F.struct(*payloads.columns), time).alias("_first")
        )
        return best.select("_first.*")
    on_disk_state(payloads.sparkSession)
    return marked.withWatermark(time, within).dropDuplicatesWithinWatermark(["_digest"]).drop("_digest")
