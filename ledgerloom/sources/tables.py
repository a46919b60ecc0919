"""Raw CSV scans, bound-parameter queries, paged reads and table sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import new_folder
from ledgerloom.sources import schemas
from ledgerloom.sources.csv_records import scan_csv_split
from ledgerloom.sources.pages import store_pages


def scan_csv(spark: SparkSession, path: str, split: bool = True) -> DataFrame:
    """Every column as text; quoted fields may hold line breaks and doubled quotes.

    A missing path raises when the scan is declared. ``split=False`` reads each file in one task,
    for files with quotes inside unquoted fields.
    """
    if split:
        return scan_csv_split(spark, path)
    return spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)


def align_headers(df: DataFrame, table: str) -> DataFrame:
    """Rename raw headers, require the target columns, keep them in order, as text."""
    renamed = df.withColumnsRenamed(schemas.HEADER_RENAMES.get(table, {}))
    wanted = schemas.STAGING_COLUMNS[table]
    missing = [c for c in wanted if c not in renamed.columns]
    if missing:
        raise ValueError(f"{table}: columns {missing} are missing from {df.columns}")
    return renamed.select(*(F.col(c).cast("string") for c in wanted))


def load_raw(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All raw tables of a folder, aligned."""
    return {
        table: align_headers(scan_csv(spark, str(PurePosixPath(folder) / name)), table)
        for table, name in schemas.CSV_FILES.items()
    }


def query_with_params(df: DataFrame, sql: str, params: Mapping[str, object]) -> DataFrame:
    """Run SQL with named parameters over ``{source}``."""
    return df.sparkSession.sql(sql, args=dict(params), source=df)


def page(df: DataFrame, key: str, limit: int, offset: int = 0) -> DataFrame:
    """One page in order of a unique text key. For more pages of one table, store its order once
    (``pages.store_pages``): a page then reads one or two files."""
    return store_pages(df, key, new_folder(df.sparkSession, "pages")).page(limit, offset)


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def rebuild_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
