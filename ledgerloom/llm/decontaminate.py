"""Benchmark decontamination: Wu-Manber search for benchmark windows over words.

Every window (13 consecutive words of an item, or all words of a shorter item) is a pattern. The
search stands at the end of a possible window and looks up the block of words there: the shift
table tells how far it may jump, as no pattern can end in between. Where the shift is zero, the
suffix block selects a bucket, the first words of the candidate select the patterns in it, and a
direct comparison of all words confirms. Patterns of very different lengths are searched in
separate passes, so short items do not spoil the shifts of the long ones.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import normal, prepare, utf8
from ledgerloom.session import materialize

WINDOW = 13
SHARE = 20  # contaminated: at least 1/20 of the words are hit
SLICE_BYTES = 32 << 20  # benchmark text compiled into one pattern set
_BANDS = ((8, 1 << 60), (4, 7), (2, 3), (1, 1))  # lengths of the patterns of one pass

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class Patterns:
    """Shift table and suffix buckets of patterns of similar length."""

    def __init__(self, windows: dict[tuple[bytes, ...], list[str]]) -> None:
        self.least = least = min(map(len, windows))
        self.block = block = 2 if least > 1 else 1
        self.farthest = least - block + 1
        self.shift: dict = {}
        # suffix block -> first words -> [(rest of the pattern, its items)]
        self.buckets: dict = defaultdict(lambda: defaultdict(list))
        for words, items in windows.items():
            for end in range(block, least + 1):
                key = words[end - block : end]
                self.shift[key] = min(self.shift.get(key, self.farthest), least - end)
            self.buckets[words[least - block : least]][words[:block]].append((list(words), items))
        self.buckets = {k: dict(v) for k, v in self.buckets.items()}

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int, list[str]]]:
        """(start, end, items) of every occurrence."""
        block, least, farthest = self.block, self.least, self.farthest
        shift = self.shift.get
        at, n = least, len(words)
        while at <= n:
            key = tuple(words[at - block : at])
            step = shift(key, farthest)
            if step:
                at += step
                continue
            start = at - least
            for pattern, items in self.buckets[key].get(tuple(words[start : start + block]), ()):
                if words[start : start + len(pattern)] == pattern:
                    yield start, start + len(pattern), items
            at += 1


def compile_patterns(items: list[tuple[str, bytes]], window: int = WINDOW) -> list[Patterns]:
    found: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for item_id, text in items:
        words = normal(text).split()
        width = min(window, len(words))
        for i in range(len(words) - width + 1 if words else 0):
            found[tuple(words[i : i + width])].add(item_id)
    bands = [{w: sorted(s) for w, s in found.items() if low <= len(w) <= high} for low, high in _BANDS]
    return [Patterns(b) for b in bands if b]


def _union(spans: list[list[int]]) -> list[list[int]]:
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return merged


def _judged(n_words: int, spans: list[list[int]], items: set[str]) -> dict:
    n_hit = sum(b - a for a, b in spans)
    return {
        "n_words": n_words,
        "n_hit": n_hit,
        "n_items": len(items),
        "items_sha256": hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(),
        "contaminated": n_hit > 0 and SHARE * n_hit >= n_words,
    }


def _search(patterns: list[Patterns], words: list[bytes]) -> tuple[list[list[int]], set[str]]:
    spans, items = [], set()
    for p in patterns:
        for a, b, found in p.search(words):
            spans.append([a, b])
            items.update(found)
    return _union(spans), items


def pattern_slices(benchmark: DataFrame, slice_bytes: int = SLICE_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """Items (item_id as text, text), in slices of at most about ``slice_bytes`` of text each.

    The size is measured before anything is collected, and only one slice is held at a time.
    Items with NULL text have no words; NULL item_ids count as the empty text.
    """
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("binary").alias("text")
    ).dropna()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    n = -(-total // slice_bytes)
    cut = items.withColumn("_slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n))))
    for i in range(n):
        yield [(r["item_id"], bytes(r["text"])) for r in cut.filter(F.col("_slice") == i).drop("_slice").collect()]


def _add_hits(patterns: list[Patterns], at: int):
    """Task that adds the hits of one slice to the hit columns, the last two."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, items = (c.to_pylist() for c in batch.columns[-2:])
            for i, text in enumerate(utf8(batch.column(at))):
                found, named = _search(patterns, normal(text).split())
                spans[i] = _union(spans[i] + found)
                items[i] = sorted(named | set(items[i]))
            last = [pa.array(c, f.type) for c, f in zip((spans, items), list(batch.schema)[-2:])]
            yield pa.RecordBatch.from_arrays(batch.columns[:-2] + last, schema=batch.schema)

    return add


def _search_passes(docs: DataFrame, benchmark: DataFrame, slice_bytes: int) -> tuple[DataFrame, list[Patterns]]:
    """``docs``, two hit columns if there are several slices, and the patterns of the last slice."""
    prepare(docs.sparkSession)
    slices = pattern_slices(benchmark, slice_bytes)
    current, following = next(slices, []), next(slices, None)
    if following is not None:
        empty = {"__spans": F.array().cast("array<array<long>>"), "__items": F.array().cast("array<string>")}
        docs = docs.withColumns(empty)
    while following is not None:
        add = _add_hits(compile_patterns(current), docs.columns.index("text"))
        docs = materialize(docs.mapInArrow(add, docs.schema), "hits")
        current, following = following, next(slices, None)
    return docs, compile_patterns(current)


def _judgements(batch: pa.RecordBatch, patterns: list[Patterns], at: int, earlier: bool) -> Iterator[dict]:
    before = zip(*(c.to_pylist() for c in batch.columns[-2:])) if earlier else iter(lambda: ([], []), None)
    for text, (spans, items) in zip(utf8(batch.column(at)), before):
        words = normal(text).split()
        found, named = _search(patterns, words)
        yield _judged(len(words), _union(spans + found), named | set(items))


def find_contamination(documents: DataFrame, benchmark: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Benchmark words in each row of ``documents`` (doc_id, text); ``benchmark`` has item_id, text.

    ``n_hit`` words lie inside an occurrence of some window, ``n_items`` items have one.
    A NULL or empty text has no words and is clean; rows of repeated or NULL doc_ids are all
    judged; an empty benchmark leaves everything clean. Other columns are not read.

    One slice of patterns is the usual case and needs one pass over the texts. A larger
    benchmark is searched slice by slice, with the hits so far stored between the passes.
    """
    docs, patterns = _search_passes(documents.select("doc_id", "text"), benchmark, slice_bytes)
    earlier = len(docs.columns) > 2

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _judgements(batch, patterns, 1, earlier)
            rows = [{"doc_id": d} | row for d, row in zip(batch.column(0).to_pylist(), found)]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return docs.mapInArrow(judge, SCHEMA)


def keep_clean(docs: DataFrame, benchmark: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Rows of ``docs`` that are not contaminated, with all their columns, in the same passes."""
    columns, schema = docs.columns, docs.schema
    at = columns.index("text")
    docs, patterns = _search_passes(docs, benchmark, slice_bytes)
    earlier = len(docs.columns) > len(columns)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [not row["contaminated"] for row in _judgements(batch, patterns, at, earlier)]
            yield batch.select(columns).filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(keep, schema)


_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64())]
    + [("items_sha256", pa.string()), ("contaminated", pa.bool_())]
)
