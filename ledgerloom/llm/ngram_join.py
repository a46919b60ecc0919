"""N-gram Jaccard join by chosen paths.

A text is the set of its runs of five words. Texts with the same words are one class. Each class
gets a MinHash sketch, a fixed-size sample of its set. A run walks down a random tree: at a node
some sketch coordinates are chosen at random, the same for all classes there, and classes that
share the token at a chosen coordinate go on together. Buckets that are small are compared by
brute force; larger ones are split again, and what is still large at the last level is compared
block against block. Runs are repeated in rounds until the links of a fresh round are almost all
known already, which estimates the recall. Linked classes form candidate parts, and inside a part
all members are compared exactly on their full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.blocks import compare_parts
from ledgerloom.llm.common import WordHasher, components, grouped_rows, mix, normal, prepare, shingles, spanning_forest, utf8
from ledgerloom.session import materialize

WORDS = 5
THRESHOLD = 0.8
COORDINATES = 64  # tokens of a sketch
SLACK = 0.2  # a sketch estimate may fall short of the threshold by this (four standard deviations)
RUNS = 6  # per round
LEAST_ROUNDS, MOST_ROUNDS = 2, 8
TARGET_RECALL = 0.99
BUCKET = 2048  # classes compared by brute force without a further split
DENSE = 0.8  # a level that keeps this share of the rows in large buckets separates nothing any more
LEVELS = 5
BLOCK = 512  # classes of a block of a large bucket
_GROUP = ["path", "turn", "_lo", "_hi"]
FILTER_BITS = 1 << 26  # 8 MB; texts of other classes need not move to the exact comparison

_SKETCHES = pa.schema([("doc_id", pa.int64()), ("class", pa.binary()), ("sketch", pa.binary())])
_PATHS = pa.schema([("path", pa.int64()), ("turn", pa.int32()), ("class", pa.binary())])
_PATHS_SQL = "path long, turn int, class binary"
_PAIRS = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("turn", pa.int32())])
_SETS = pa.schema([("class", pa.binary()), ("payload", pa.binary())])


def _sketch_constants() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 32, COORDINATES, np.uint32), rng.integers(0, 1 << 31, COORDINATES, np.uint32) * np.uint32(2) + np.uint32(1)


def class_of(text: bytes | None) -> tuple[bytes | None, bytes]:
    """Digest of the words of a text (None without words) and its normal form."""
    clean = normal(text)
    words = b" ".join(clean.split())
    return (hashlib.md5(words).digest() if words else None), clean


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    xors, factors = _sketch_constants()
    hasher = WordHasher()
    for batch in batches:
        ids, sets, lengths = [], [], []
        for text in utf8(batch.column(1)):
            digest, clean = class_of(text)
            ids.append(digest)
            if digest:
                sets.append((shingles(hasher.hashes(clean), WORDS) >> np.uint64(32)).astype(np.uint32))
                lengths.append(len(sets[-1]))
        sketches: list[bytes | None] = [None] * len(ids)
        if sets:
            tokens = np.concatenate(sets)
            starts = np.cumsum([0] + lengths[:-1])
            found = np.empty((len(sets), COORDINATES), np.uint32)
            for i in range(COORDINATES):
                found[:, i] = np.minimum.reduceat((tokens ^ xors[i]) * factors[i], starts)
            rows = iter(found)
            sketches = [next(rows).tobytes() if d else None for d in ids]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(ids, pa.binary()), pa.array(sketches, pa.binary())], schema=_SKETCHES
        )


def _matrix(column: pa.Array) -> np.ndarray:
    """Sketches of a batch, one row each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _children(paths: np.ndarray, sketches: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path) of every chosen coordinate; a coordinate is chosen with a chance of
    1 / (threshold * coordinates), so a pair at the threshold goes on in one bucket on average."""
    places = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64))
    draws = mix(paths[:, None] ^ places[None, :])
    chance = np.uint64(int(2**64 / (threshold * COORDINATES)))
    rows, at = np.nonzero(draws < chance)
    return rows, mix(draws[rows, at] + mix(sketches[rows, at].astype(np.uint64) + np.uint64(1)))


def _roots(turns: list[int], threshold: float):
    """Task that gives the first paths of the runs of the rounds ``turns``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sketches = _matrix(batch.column("sketch"))
            for turn in turns:
                for r in range(turn * RUNS, (turn + 1) * RUNS):
                    roots = np.full(len(sketches), mix(np.array([r + 1], np.uint64))[0])
                    rows, paths = _children(roots, sketches, threshold)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(paths.view(np.int64)),
                            pa.array(np.full(len(rows), turn, np.int32)),
                            batch.column("class").take(pa.array(rows)),
                        ],
                        schema=_PATHS,
                    )

    return run


def _split(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            paths = batch.column("path").to_numpy().view(np.uint64)
            rows, paths = _children(paths, _matrix(batch.column("sketch")), threshold)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(paths.view(np.int64)), batch.column("turn").take(at), batch.column("class").take(at)], schema=_PATHS
            )

    return run


def _alike(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Boolean matrix of the pairs whose sketches agree in a share of at least ``least``."""
    agree = np.zeros((len(a), len(b)), np.uint8)
    for i in range(COORDINATES):
        agree += a[:, i, None] == b[None, :, i]
    return agree >= least * COORDINATES


def _brute_force(least: float):
    """Task over buckets cut into pairs of blocks: spanning forests of their similar pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for (_, turn, lo, hi), group in grouped_rows(batches, _GROUP):
            left = [r for r in group if r["_block"] == lo]
            right = left if lo == hi else [r for r in group if r["_block"] == hi]
            if not left or not right:
                continue
            x, y = (np.frombuffer(b"".join(r["sketch"] for r in s), np.uint32).reshape(-1, COORDINATES) for s in (left, right))
            near = _alike(x, y, least)
            shift, both = (0, left) if lo == hi else (len(left), left + right)
            pairs = ((int(i), int(j) + shift) for i, j in zip(*np.nonzero(np.triu(near, 1) if lo == hi else near)))
            rows += [{"a": both[i]["class"], "b": both[j]["class"], "turn": turn} for i, j in spanning_forest(len(both), pairs)]
            if len(rows) >= 5000:
                yield pa.RecordBatch.from_pylist(rows, schema=_PAIRS)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, schema=_PAIRS)

    return run


def _sized(paths: DataFrame) -> DataFrame:
    """Rows of buckets with at least two classes, with the bucket's size."""
    sizes = paths.groupBy("path", "turn").agg(F.count("*").alias("size")).filter("size > 1")
    return paths.join(sizes, ["path", "turn"])


def candidate_links(classes: DataFrame, turns: list[int], threshold: float) -> DataFrame:
    """(a, b, turn) edges of classes (class, sketch) found in some buckets of the rounds ``turns``.

    Rounds share no bucket; taken together they share the stages.
    """
    sketches = classes.select("class", "sketch")
    paths = sketches.mapInArrow(_roots(turns, threshold), _PATHS_SQL)
    leaves, before = [], None
    for level in range(LEVELS):
        sized = materialize(_sized(paths), "buckets")
        rows = sized.filter(F.col("size") > BUCKET).count()
        # Near copies stay together however often they are split; they are compared in blocks.
        last = rows == 0 or level == LEVELS - 1 or (before is not None and rows > DENSE * before)
        before = rows
        leaves.append(sized if last else sized.filter(F.col("size") <= BUCKET))
        if last:
            break
        large = sized.filter(F.col("size") > BUCKET).select("path", "turn", "class").join(sketches, "class")
        paths = large.select("path", "turn", "class", "sketch").mapInArrow(_split(threshold), _PATHS_SQL)
    buckets = leaves[0]
    for more in leaves[1:]:
        buckets = buckets.union(more)
    blocks = F.ceil(F.col("size") / BLOCK)
    buckets = buckets.withColumn("_blocks", blocks).withColumn("_block", F.pmod(F.xxhash64("class"), F.col("_blocks")))
    buckets = buckets.withColumn("_with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    buckets = buckets.select(
        "path", "turn", F.least("_block", "_with").alias("_lo"), F.greatest("_block", "_with").alias("_hi"), "_block", "class"
    )
    met = buckets.join(sketches, "class").repartition(*_GROUP).sortWithinPartitions(*_GROUP, "class")
    met = met.select(*_GROUP, "_block", "class", "sketch")
    return met.mapInArrow(_brute_force(threshold - SLACK), "a binary, b binary, turn int").distinct()


def _parts_before_and_after(edges: DataFrame, last: int) -> tuple[DataFrame, DataFrame]:
    """Components (node, component) of the edges before round ``last`` and of all edges.

    Both graphs are labelled in the same jobs: a first byte keeps their nodes apart.
    """
    def marked(rows: DataFrame, mark: bytes) -> DataFrame:
        return rows.select(*(F.concat(F.lit(mark), F.col(c)).alias(c) for c in ("a", "b")))

    labels = components(marked(edges.filter(F.col("turn") < last), b"\0").union(marked(edges, b"\1")))

    def of(mark: bytes) -> DataFrame:
        rows = labels.filter(F.expr("substring(node, 1, 1)") == F.lit(mark))
        return rows.select(F.expr("substring(node, 2)").alias("node"), F.expr("substring(component, 2)").alias("component"))

    return of(b"\0"), of(b"\1")


def _places(digests: list[bytes]) -> np.ndarray:
    """Two bits of the filter per digest."""
    heads = np.frombuffer(b"".join(d[:8] for d in digests), np.uint64)
    return np.stack([heads % np.uint64(FILTER_BITS), (heads >> np.uint64(32)) % np.uint64(FILTER_BITS)], axis=1).astype(np.int64)


def class_filter(members: DataFrame) -> np.ndarray:
    """Bit set of FILTER_BITS bits, whatever the number of classes: which digests may be members.

    With very many members it fills up and lets more texts pass, which the join after it sorts out.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            if batch.num_rows:
                bits[_places(batch.column(0).to_pylist()).reshape(-1)] = True
        words = np.packbits(bits, bitorder="little").view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], names=["word", "bits"])

    marked = members.select("class").mapInArrow(mark, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    table = marked.toArrow()
    words = np.zeros(FILTER_BITS // 64, np.int64)
    words[table["word"].to_numpy()] = table["bits"].to_numpy()
    return words


def _sets_of_members(words: np.ndarray):
    """Task that turns the texts whose class may be a member into sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            found = [(d, clean) for d, clean in map(class_of, utf8(batch.column(0))) if d]
            if not found:
                continue
            places = _places([d for d, _ in found])
            passed = (words[places >> 6] >> (places & 63) & 1).all(axis=1)
            kept = [row for row, ok in zip(found, passed.tolist()) if ok]
            sets = [np.unique(shingles(hasher.hashes(clean), WORDS)).tobytes() for _, clean in kept]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in kept], pa.binary()), pa.array(sets, pa.binary())], schema=_SETS)

    return run


def jaccard_linked(threshold: float):
    """Boolean matrix of two lists of sorted sets, by counting common members exactly."""

    def linked(a: list[bytes], b: list[bytes]) -> np.ndarray:
        x, y = ([np.frombuffer(s, np.uint64) for s in side] for side in (a, b))
        same = a is b or a == b
        n, m = np.array([len(s) for s in x]), np.array([len(s) for s in y])
        common = np.zeros((len(x), len(y)), np.int64)
        if len(x) * len(y) <= 36:
            for i in range(len(x)):
                for j in range(i if same else 0, len(y)):
                    common[i, j] = len(np.intersect1d(x[i], y[j], assume_unique=True))
                    if same:
                        common[j, i] = common[i, j]
        else:
            sets = x if same else x + y
            _, tokens = np.unique(np.concatenate(sets), return_inverse=True)
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            width = 4096
            for low in range(0, int(tokens[-1]) + 1, width):
                s, e = np.searchsorted(tokens, [low, low + width])
                held = np.zeros((len(sets), width), np.float32)
                held[owner[s:e], tokens[s:e] - low] = 1
                left, right = (held, held) if same else (held[: len(x)], held[len(x) :])
                common += (left @ right.T).astype(np.int64)
        return common / (n[:, None] + m[None, :] - common) >= threshold

    return linked


def join_near_texts(documents: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """class_id, n_links, component_id and kept of each row of ``documents`` (doc_id, text).

    Rows are linked if the Jaccard similarity of their sets of five-word runs is ``threshold`` or
    more; a text of one to four words is one run. ``class_id`` is the smallest doc_id with the
    same words, ``n_links`` counts all other rows linked directly (those of the same class too),
    ``component_id`` is the smallest doc_id that links reach, and ``kept`` rows have it. NULL
    texts and texts without words link with nothing and are kept. Rows of one doc_id are rows of
    their own; a NULL doc_id is never the smallest. An empty table gives an empty result. The
    digests of the class and of the group are returned as well. Other columns are not read.
    """
    prepare(documents.sparkSession)
    rows = documents.select("doc_id", "text")
    base = materialize(rows.mapInArrow(_sketched, "doc_id long, class binary, sketch binary"), "sketches")
    classes = base.filter("class is not null").groupBy("class").agg(
        F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.min("sketch").alias("sketch")
    )
    classes = materialize(classes, "classes")

    last = LEAST_ROUNDS - 1
    edges = materialize(candidate_links(classes, list(range(LEAST_ROUNDS)), threshold), "links")
    while True:
        before, parts = _parts_before_and_after(edges, last)
        # Share of the fresh links that stay inside the parts known before, averaged over the parts
        # of now: a large group counts once.
        inside = edges.filter(F.col("turn") == last)
        inside = inside.join(before.select(F.col("node").alias("a"), F.col("component").alias("_x")), "a", "left")
        inside = inside.join(before.select(F.col("node").alias("b"), F.col("component").alias("_y")), "b", "left")
        inside = inside.join(parts.select(F.col("node").alias("a"), F.col("component").alias("_part")), "a", "left")
        shares = inside.groupBy("_part").agg((F.count(F.when(F.col("_x") == F.col("_y"), 1)) / F.count("*")).alias("_share"))
        known = shares.agg(F.avg("_share")).first()[0]
        if known is None or 1 - (1 - known) ** 2 >= target:
            break
        if last + 1 >= MOST_ROUNDS:
            raise RuntimeError(f"recall stays below {target} after {MOST_ROUNDS} rounds")
        last += 1
        edges = edges.union(materialize(candidate_links(classes, [last], threshold), "links"))

    members = parts.select(F.col("node").alias("class"), F.col("component").alias("part")).join(classes.select("class", "copies"), "class")
    members = materialize(members, "members")
    # Only texts that pass the filter move; copies of a text shrink map-side.
    sets = documents.select("text").mapInArrow(_sets_of_members(class_filter(members)), "class binary, payload binary")
    sets = sets.groupBy("class").agg(F.min("payload").alias("payload"))
    ready = members.join(sets, "class").select("part", F.col("class").alias("node"), "copies", "payload")
    exact = materialize(compare_parts(ready, jaccard_linked(threshold), 256), "exact")

    links = exact.filter("other is null").groupBy("node").agg(F.sum("n").alias("_links"))
    joined = components(exact.filter("other is not null"), "node", "other")
    first = classes.select(F.col("class").alias("node"), "first")
    smallest = joined.join(first, "node").groupBy("component").agg(F.min("first").alias("_smallest"))
    known = (
        classes.select("class", "first", "copies")
        .join(links.withColumnRenamed("node", "class"), "class", "left")
        .join(joined.join(smallest, "component").select(F.col("node").alias("class"), "component", "_smallest"), "class", "left")
    )
    out = base.select("doc_id", "class").join(known, "class", "left")
    component = F.coalesce("_smallest", "first", "doc_id")
    return out.select(
        "doc_id",
        F.coalesce("first", "doc_id").alias("class_id"),
        (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("_links", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"),
        F.lower(F.hex("class")).alias("class_digest"),
        F.lower(F.hex(F.coalesce("component", "class"))).alias("group_digest"),
    )


def keep_one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs``, one of each group of near copies, with all their columns.

    The kept row has the smallest doc_id of its group; of several rows with that doc_id the first
    by text stays. Rows without words all stay.
    """
    kept = join_near_texts(docs, threshold).filter("kept and class_digest is not null")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    plan = kept.groupBy(key.alias("__key"), "group_digest").agg(F.min("class_digest").alias("__class"))
    plan = plan.select("__key", "__class", F.lit(True).alias("__chosen"))
    at = docs.columns.index("text")

    def add_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [d.hex() if (d := class_of(text)[0]) else None for text in utf8(batch.column(at))]
            yield pa.RecordBatch.from_arrays(batch.columns + [pa.array(ids, pa.string())], names=batch.schema.names + ["__class"])

    rows = docs.mapInArrow(add_class, T.StructType([*docs.schema.fields, T.StructField("__class", T.StringType())]))
    rows = rows.withColumn("__key", key).join(plan, ["__key", "__class"], "left")
    nth = F.row_number().over(Window.partitionBy("__key", "__class").orderBy(F.md5("text")))
    rows = rows.withColumn("__nth", nth)
    return rows.filter("__class is null or (__chosen and __nth = 1)").select(*docs.columns)
