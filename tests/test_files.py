"""CSV files read by many tasks, and stored pages."""

from __future__ import annotations

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from ledgerloom.session import new_folder
from ledgerloom.sources import pages, tables
from ledgerloom.sources.csv_records import csv_records, numbered_lines


@pytest.fixture
def small_ranges(spark):
    """Byte ranges so small that most records cross one."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in zip(names, ("64", "0", "1"), strict=True):
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def random_rows(n, seed=4):
    rng = random.Random(seed)
    parts = ["plain", 'a "quoted" word', "two\nlines", 'a,"b"\n\n"c"', "é日", "", "x" * 150, "\n", 'end"', "tab\there"]
    return [[str(i), *(rng.choice(parts) for _ in range(3))] for i in range(n)]


def as_csv(data, header, end="\n"):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(header)
    writer.writerows(data)
    return out.getvalue()


HEADER = ["id", "a", "b", "c"]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_split_files_equal_one_task(spark, small_ranges, tmp_path, end):
    for i in range(2):
        (tmp_path / f"f{i}.csv").write_bytes(as_csv(random_rows(60, i), HEADER, end).encode())
    lines = numbered_lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() > 50 and lines.select("_file", "_start").distinct().count() > 50
    got = tables.scan_csv(spark, str(tmp_path))
    want = tables.scan_csv(spark, str(tmp_path), split=False)
    assert got.columns == HEADER and got.count() == 120
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_a_record_over_many_ranges(spark, small_ranges, tmp_path):
    long = "\n".join(f"line {i}, \"\"" for i in range(100))
    (tmp_path / "f.csv").write_text(as_csv([["1", long, "x", "y"], ["2", "a", "b", "c"]], HEADER))
    got = {r["id"]: r["a"] for r in tables.scan_csv(spark, str(tmp_path)).collect()}
    assert got == {"1": long, "2": "a"}


def test_records_are_cut_at_even_quotes(spark, tmp_path):
    (tmp_path / "f.csv").write_text('h\n"a\nb"\n\nc\n')
    records = csv_records(numbered_lines(spark, str(tmp_path)))
    assert sorted((r["record"], r["first"]) for r in records.collect()) == [('"a\nb"', False), ("c", False), ("h", True)]


def test_files_with_columns_in_another_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x\n1,one\n")
    (tmp_path / "b.csv").write_text("﻿x,id,more\ntwo,2,m\n")
    got = tables.scan_csv(spark, str(tmp_path))
    assert sorted((r["id"], r["x"], r["more"]) for r in got.collect()) == [("1", "one", None), ("2", "two", "m")]


def test_a_file_without_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x\n")
    assert tables.scan_csv(spark, str(tmp_path)).columns == ["id", "x"]
    assert tables.scan_csv(spark, str(tmp_path)).collect() == []
    (tmp_path / "a.csv").write_text("")
    with pytest.raises(ValueError, match="header"):
        tables.scan_csv(spark, str(tmp_path))


@pytest.fixture(scope="module")
def stored(spark):
    df = spark.range(95).select(F.format_string("%03d", "id").alias("k"), (F.col("id") * 2).alias("v")).repartition(4)
    return pages.store_pages(df, "k", new_folder(spark, "pages"), rows_per_zone=10)


def test_a_page_opens_the_files_of_its_rows(stored):
    for offset in (0, 7, 40, 85):
        page = stored.page(10, offset)
        assert len(page.inputFiles()) <= 2
        assert rows(page) == [(f"{i:03d}", 2 * i) for i in range(offset, min(offset + 10, 95))]
    assert stored.page(10, 95).collect() == [] and stored.page(10, 1000).collect() == []
    assert stored.zones().count() == 10


def test_pages_behind_a_key(stored):
    seen, key = [], None
    while got := stored.after(key, 30).collect():
        key = got[-1]["k"]
        seen += [r["k"] for r in got]
    assert seen == [f"{i:03d}" for i in range(95)]
    assert len(stored.after("050", 10).inputFiles()) <= 2
    assert rows(stored.after("0505", 2).select("k")) == [("051",), ("052",)]
