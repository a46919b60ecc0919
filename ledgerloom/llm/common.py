"""Helpers shared by the operators: words, hashes, Arrow batches, connected components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import materialize

# Words are runs of digits, ASCII letters and all code points above 127; A-Z count as a-z. In
# UTF-8 every other code point is one byte that separates words.
_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
ROWS_PER_BATCH = 500


def prepare(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches small: one text may hold megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    return spark


def normal(text: bytes | None) -> bytes:
    """UTF-8 text with every separator as a space and A-Z lower-cased; NULL is empty."""
    return (text or b"").translate(_WORD_BYTES)


def utf8(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


_P = np.uint64(0x9E3779B97F4A7C15)


def _inverse(p: int) -> int:
    return pow(p, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHasher:
    """64-bit hashes of all words of a text, without a Python object per word.

    A word's hash is a difference of prefix sums of byte * P^i, shifted back to i = 0.
    """

    def __init__(self) -> None:
        self._powers = np.ones(1, np.uint64)
        self._backs = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._powers) < n:
            size = max(n, 2 * len(self._powers), 1 << 16)
            for name, p in (("_powers", int(_P)), ("_backs", _inverse(int(_P)))):
                steps = np.full(size, p, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def hashes(self, text: bytes | None) -> np.ndarray:
        data = np.frombuffer(normal(text), np.uint8)
        if not len(data):
            return np.empty(0, np.uint64)
        self._grow(len(data) + 1)
        inside = data != 32
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data * self._powers[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self._backs[starts])


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words; a shorter text is one shingle of all its words."""
    if not len(words):
        return words
    width = min(n, len(words))
    count = len(words) - width + 1
    out = np.full(count, np.uint64(width))
    for j in range(width):
        out = out * _P + words[j : j + count]
    return mix(out)


def grouped_rows(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Groups of a partition that is sorted by ``keys``, across batch borders."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for key, members in groupby(rows, key=lambda row: tuple(row[k] for k in keys)):
        yield key, list(members)


def spanning_forest(n: int, pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """(first member, member) of every connected part: at most n - 1 edges with the same parts.

    Parts that meet in several groups give mostly the same edges, as each hangs on its first member.
    """
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(r, i) for i in range(n) if (r := root(i)) != i]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an edge list; the component is the smallest node.

    Nodes hook on to the smallest label around them and labels jump to the label of their
    label, so long chains shrink quickly. Each round is stored; only a count reaches the driver.
    A node with very many edges is summed map-side by ``min``.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("near")).filter("node <> near").distinct()
    both = materialize(both.union(both.select("near", "node")), "edges")
    labels = materialize(
        both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("component")),
        "labels",
    )
    while True:
        around = both.join(labels.select(F.col("node").alias("near"), "component"), "near")
        lowest = around.groupBy("node").agg(F.min("component").alias("lowest"))
        hooked = labels.join(lowest, "node").select(
            "node", "component", F.least("component", "lowest").alias("next")
        )
        # The old label learns of the new one too, so a whole part moves at once.
        moves = hooked.filter("next < component").groupBy(F.col("component").alias("next")).agg(F.min("next").alias("jump"))
        jumped = hooked.join(moves, "next", "left").select(
            "node", F.col("component").alias("was"), F.least(F.coalesce("jump", "next"), F.col("next")).alias("component")
        )
        jumped = materialize(jumped, "labels")
        labels = jumped.select("node", "component")
        if jumped.filter("component <> was").isEmpty():
            return labels
