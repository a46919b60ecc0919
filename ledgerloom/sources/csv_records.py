"""CSV records of files that many tasks read at once, although fields may hold line breaks.

A line break ends a record only if the quotes before it, from the start of the file, are even in
number. Files are read as lines in byte ranges. Each range counts its quotes; the counts of the
ranges before it say whether a range starts inside a field, and a running count inside the range
then marks the lines at which records start. Lines of one record are joined, wherever the ranges
cut it, and parsed by the built-in CSV parser.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.session import materialize

_BLOCK = ["_file", "_start"]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _start, _at, line): lines with the byte range they were read in and a number that
    grows inside the range. A carriage return at the end stays."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
        F.col("value").alias("line"),
    )


def _quotes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))


def csv_records(lines: DataFrame) -> DataFrame:
    """(_file, record, first): the text of each record, and whether it is the first of its file.

    A window holds the lines of one byte range. Only records of several lines are grouped. Empty
    lines between records are left out.
    """
    lines = lines.withColumn("_quotes", _quotes(F.col("line")))
    # One row per byte range, summed along each file.
    blocks = lines.groupBy(*_BLOCK).agg(F.sum("_quotes").alias("_q"))
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*_BLOCK, F.coalesce(F.sum("_q").over(before), F.lit(0)).alias("_before"))

    inside = Window.partitionBy(*_BLOCK).orderBy("_at")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    marked = lines.withColumn("_seen", F.coalesce(F.sum("_quotes").over(earlier), F.lit(0))).join(blocks, _BLOCK)
    odd = (F.col("_before") + F.col("_seen")) % 2 == 1
    ends = (F.col("_before") + F.col("_seen") + F.col("_quotes")) % 2 == 0
    marked = marked.select(*_BLOCK, "_at", "line", (~odd).alias("_starts"), ends.alias("_ends"))
    marked = materialize(marked, "csv_lines")

    whole = marked.filter("_starts AND _ends").select("_file", "_start", "_at", F.col("line").alias("record"))
    # Of a record over several lines, each line takes the place of the record's first line. A
    # range that starts inside a record leaves that to the last start of an earlier range.
    parts = marked.filter("NOT (_starts AND _ends)")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("_head", F.last(F.when(F.col("_starts"), F.col("_at")), ignorenulls=True).over(upto))
    heads = parts.groupBy(*_BLOCK).agg(F.max("_head").alias("_last"))
    along = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    carried = heads.select(
        *_BLOCK,
        F.last(F.when(F.col("_last").isNotNull(), F.struct("_start", "_last")), ignorenulls=True).over(along).alias("_open"),
    )
    parts = parts.join(carried, _BLOCK).select(
        "_file",
        F.when(F.col("_head").isNull(), F.col("_open._start")).otherwise(F.col("_start")).alias("_from"),
        F.coalesce("_head", "_open._last").alias("_head"),
        F.struct("_start", "_at", "line").alias("_line"),
    )
    joined = parts.groupBy("_file", F.col("_from").alias("_start"), F.col("_head").alias("_at")).agg(
        F.array_sort(F.collect_list("_line")).alias("_lines")
    )
    joined = joined.select("_file", "_start", "_at", F.concat_ws("\n", F.col("_lines.line")).alias("record"))
    records = whole.unionByName(joined).withColumn("record", F.regexp_replace("record", "\r$", ""))
    records = records.filter("record <> ''")
    heads = records.groupBy("_file").agg(F.min(F.struct("_start", "_at")).alias("_first"))
    is_first = F.struct("_start", "_at") == F.col("_first")
    return records.join(heads, "_file").select("_file", "record", is_first.alias("first"))


def scan_csv_split(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text, like a multi-line scan, with every file split.

    Fields that hold quotes must be quoted, with the quotes doubled. Each file names its own
    columns in its first record; files with the same columns in another order meet by name, and a
    column that a file lacks is NULL there. The distinct headers, a few, are read when the scan is
    declared.
    """
    records = csv_records(numbered_lines(spark, path))
    clean = F.regexp_replace("record", "^﻿", "")
    headers = records.filter("first").select("_file", clean.alias("_header"))
    rows = records.filter("NOT first").join(headers, "_file")
    parts = []
    for (header,) in headers.select("_header").distinct().orderBy("_header").collect():
        names = _fields(spark, header)
        parsed = F.from_csv("record", _ddl(names), {"escape": '"', "multiLine": "true"})
        parts.append(rows.filter(F.col("_header") == header).select(parsed.alias("r")).select("r.*"))
    if not parts:
        raise ValueError(f"{path} holds no header")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _ddl(names: list[str]) -> str:
    return ", ".join(f"`{n.replace('`', '``')}` STRING" for n in names)


def _fields(spark: SparkSession, header: str) -> list[str]:
    """Column names of a header record, split by the CSV parser itself."""
    width = header.count(",") + 1
    row = spark.range(1).select(
        F.from_csv(F.lit(header), _ddl([f"c{i}" for i in range(width)]), {"escape": '"', "multiLine": "true"}).alias("r")
    ).first()["r"]
    return [v for v in row if v is not None]
