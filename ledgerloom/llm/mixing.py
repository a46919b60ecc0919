"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its shuffled documents, gone through up to ``repeats`` times. A
document's virtual finish time is the number of words its source has sent when it ends, divided
by the source's target. All queues are merged in the order of finish times and cut off at the
total budget, so every source has sent about its target. Only built-in column functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.ordered import ordered_prefix, pieces_of
from ledgerloom.session import materialize

WEIGHTS = (1, 2, 3)  # of the sources in order, repeating
REPEATS = 3


def size_of(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources by code point, NULL last, get the weights in turn and share the sum of all sizes. A
    target stops at ``repeats`` times its source's size; the excess goes to the others by weight.
    That is one water level: sources are tried in the order in which they fill up, and the level
    is what the budget leaves for the rest. The windows see one row per source.
    """
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_full", repeats * F.col("source_size") / F.col("_weight"))
    order = Window.orderBy("_full", "_rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.withColumn("_total", F.sum("source_size").over(everything)).withColumn(
        "_level",
        (F.col("_total") - repeats * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("_weight").over(onward),
    )
    # The first source in that order that stays below its cap; later levels are not higher.
    level = F.max(F.when(F.col("_full") >= F.col("_level"), F.col("_level"))).over(everything)
    target = F.least((repeats * F.col("source_size")).cast("double"), F.col("_weight") * F.col("_water"))
    return ranked.withColumn("_water", level).select("source", "source_size", target.cast("double").alias("target"))


def mix_sources(
    documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = 7
) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (copies * size) of each document, and
    its number ``nth`` among equal rows.

    ``documents`` has doc_id, text and source. NULL and blank texts have size 0 and are never
    taken. Rows of repeated or NULL doc_ids are queued one by one. An empty table gives an empty
    result. The shuffle is an md5 of seed and doc_id, so reruns agree; ties go by doc_id, text
    digest and source. Other columns are not read. Also returns text_digest and source, which
    tell rows of one doc_id apart.
    """
    source = F.col("source").cast("string")
    docs = documents.select(
        "doc_id",
        source.alias("source"),
        size_of(F.col("text")).alias("size"),
        F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("text_digest"),
    )
    shuffled = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    docs = materialize(docs.withColumn("_at", shuffled), "mix_sizes")
    targets = source_targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats)
    targets = materialize(targets, "mix_targets")
    budget = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]

    # A piece for every shuffle partition at least: one source may hold a large share of few rows.
    rows, least = docs.count(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    # NULL is a queue of its own: queues are told apart by (is null, name).
    queue = docs.withColumns({"_null": F.col("source").isNull(), "_name": F.coalesce("source", F.lit(""))})
    sent = ordered_prefix(
        queue, ["_null", "_name"], "_at", {"_before": F.col("size")}, store=False, ties=("doc_id", "text_digest"),
        pieces=max(least, pieces_of(rows)),
    )
    sent = sent.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    passes = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
    queued = sent.filter("size > 0").select(
        "doc_id", "source", "text_digest", "size", "source_size", "target", "_at", "_before", passes.alias("_pass")
    )
    ended = F.col("_pass") * F.col("source_size") + F.coalesce("_before", F.lit(0)) + F.col("size")
    queued = queued.withColumn("_finish", ended / F.col("target"))
    merged = ordered_prefix(
        queued, [], "_finish", {"_sent": F.col("size")}, ties=("_at", "doc_id", "text_digest", "source", "_pass"),
        pieces=max(least, pieces_of(repeats * rows)),
    )
    taken = merged.filter(F.coalesce("_sent", F.lit(0)) + F.col("size") <= budget)
    # Copies per document; equal rows share theirs evenly, the first ones get the rest.
    key = ["doc_id", "source", "text_digest"]
    copies = taken.groupBy(*key).agg(F.count("*").alias("_copies"))
    rows = docs.groupBy(*key, "size").agg(F.count("*").alias("_rows"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in key]
    shared = rows.alias("r").join(copies.alias("c"), same, "left").select("r.*", F.coalesce("c._copies", F.lit(0)).alias("_copies"))
    each = shared.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))))
    share = F.floor(F.col("_copies") / F.col("_rows")) + (F.col("_i") <= F.col("_copies") % F.col("_rows")).cast("long")
    each = each.withColumn("copies", share.cast("long"))
    each = each.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left")
    return each.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source", "text_digest",
        F.col("_i").alias("nth"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs``, each as often as the mix takes it, with all their columns.

    Rows meet their number of copies by doc_id, source and text; of rows equal in these, the n-th
    in the order of a hash of all their columns takes the n-th share. Both meet in one exchange.
    """
    def mark(value: Column) -> Column:
        return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("-"))

    def key(digest: Column) -> Column:
        return F.md5(F.concat_ws("|", digest, mark(F.col("doc_id")), mark(F.col("source")))).alias("_key")

    columns = [F.col(f"`{c}`") for c in docs.columns]
    none = F.lit(None)
    texts = docs.select(
        F.struct(*columns).alias("_row"), key(F.md5(F.coalesce(F.col("text"), F.lit("")))),
        none.cast("long").alias("_copies"), F.xxhash64(*columns).alias("_order"),
    )
    plan = mix_sources(docs, **options).filter("copies > 0").select(
        none.cast(texts.schema["_row"].dataType).alias("_row"), key(F.col("text_digest")),
        F.col("copies").alias("_copies"), F.col("nth").cast("long").alias("_order"),
    )
    # Both numberings and the pairing reuse the exchange by key.
    both = texts.unionByName(plan).repartition("_key")
    nth = F.row_number().over(Window.partitionBy("_key", F.col("_row").isNull()).orderBy("_order"))
    pair = Window.partitionBy("_key", "_nth")
    met = both.withColumn("_nth", nth).withColumn("_copies", F.max("_copies").over(pair))
    met = met.filter("_row IS NOT NULL AND _copies > 0")
    repeated = met.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return repeated.select("_row.*")
