"""Shards by proportional stratified interleaving.

Within each source, rows are ranked in a seeded shuffle. A row's fractional rank is its rank, plus
a start between 0 and 1 that the seed draws for the source, over the rows of the source. Sorted by
fractional rank, every stretch of the order holds each source in its share of the whole, so
cutting the order into stretches of equal row counts gives shards that all match the mixture.

Places are computed on thin rows. Texts meet their places in one exchange: the pieces of that
exchange are ranges of the shuffle hash, which run alongside the order, so a piece holds rows of
one or two shards and the number of files follows the data. Only built-in column functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.ranks import ranked
from ledgerloom.session import materialize

SHARDS = 8
SEED = 11
LAW = "rows"  # row counts of the shards are at most one apart
BYTES_PER_PIECE = 32 << 20
ROWS_PER_PIECE = 50_000


def size_of(text: Column) -> Column:
    """UTF-8 bytes plus one; NULL has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def crc_of(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def shuffle_key(seed: int) -> Column:
    """Seeded hash of a row: rows that share it are equal in doc_id, source and text."""
    def mark(value: Column) -> Column:
        return F.coalesce(F.concat(F.lit("="), value), F.lit("-"))

    return F.md5(F.concat_ws(
        "|", F.lit(str(seed)), mark(F.col("doc_id").cast("string")), mark(F.col("source").cast("string")), mark(F.md5("text"))
    ))


def _unit(text: Column, digits: int = 13) -> Column:
    """Number in [0, 1) from the first hex digits of an md5."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long") / F.lit(float(1 << 4 * digits))


def place_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, shard, slot and the row's shuffle key, one row per document row.

    ``docs`` has doc_id, source and text. Slots run from 0 without gaps in each shard. NULL is a
    source of its own. NULL and empty texts are rows like others. Rows of repeated or NULL doc_ids
    are placed one by one; rows equal in doc_id, source and text take their places in any order.
    Equal texts are not kept together. An empty table gives an empty result; with fewer rows than
    shards some shards stay empty. Other columns are not read. Reruns agree.
    """
    thin = docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        size_of(F.col("text")).alias("size"),
        shuffle_key(seed).alias("_key"),
        F.col("source").isNull().alias("_null"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_name"),
    )
    thin = materialize(thin, "shard_rows")
    rows = thin.count()
    within = ranked(thin, ["_null", "_name"], ["_key"], "_rank", "_of")
    start = _unit(F.concat(F.lit(f"{seed}:"), F.col("_name")))
    spread = materialize(within.withColumn("_part", (F.col("_rank") + start) / F.col("_of")), "shard_ranks")
    # One order over all sources; the pieces alone meet in a window without a key.
    placed = ranked(spread, [], ["_part", "_key"], "_at")
    placed = placed.withColumn("shard", F.expr(f"_at * {shards} div {max(rows, 1)}").cast("int"))
    # The first place of shard k is k * rows / shards, rounded up.
    first = F.expr(f"(shard * {rows}L + {shards - 1}) div {shards}")
    return placed.select("doc_id", "source", "size", "shard", (F.col("_at") - first).alias("slot"), "_key")


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Write whole rows to ``folder/shard=k`` as Parquet and return the stored rows.

    Stored columns are those of ``docs``, the row's ``slot`` in its shard and the folder's
    ``shard``; columns of ``docs`` with these two names are replaced. Each file is sorted by slot and
    holds one range of the shuffle, so the files of a shard overlap with their neighbours only.
    """
    places = materialize(place_documents(docs, shards, seed), "shard_places")
    rows, size = places.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    pieces = max(1, -(-size // BYTES_PER_PIECE), -(-rows // ROWS_PER_PIECE))
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    texts = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row"), shuffle_key(seed).alias("_key"))
    none = F.lit(None)
    both = texts.select("_row", "_key", none.cast("int").alias("shard"), none.cast("long").alias("slot")).unionByName(
        places.select(none.cast(texts.schema["_row"].dataType).alias("_row"), "_key", "shard", "slot")
    )
    start = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    piece = F.shiftright(start * F.lit(pieces), 32).cast("int")
    both = both.withColumn("_piece", piece).repartitionById(pieces, F.col("_piece"))
    # The n-th row of a key takes the n-th place of the key; both numberings and the pairing
    # reuse the exchange by piece.
    nth = F.row_number().over(Window.partitionBy("_piece", "_key", F.col("_row").isNull()).orderBy("shard", "slot"))
    pair = Window.partitionBy("_piece", "_key", "_nth")
    met = both.withColumn("_nth", nth).withColumns({c: F.max(c).over(pair) for c in ("shard", "slot")})
    met = met.filter("_row IS NOT NULL").sortWithinPartitions("shard", "slot")
    met.select("_row.*", "shard", "slot").write.partitionBy("shard").parquet(folder)
    stored = docs.select(*(F.col(f"`{c}`") for c in kept)).schema
    stored = T.StructType([*stored.fields, T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    return docs.sparkSession.read.schema(stored).parquet(folder)


def shard_report(stored: DataFrame) -> DataFrame:
    """Digests of the stored shards: one row per document, from the files alone.

    doc_id, size, text_crc32, law, shard, slot, and grown_shard, which is NULL: another shard
    count cuts the order anew.
    """
    return stored.select(
        "doc_id",
        size_of(F.col("text")).alias("size"),
        crc_of(F.col("text")).alias("text_crc32"),
        F.lit(LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
