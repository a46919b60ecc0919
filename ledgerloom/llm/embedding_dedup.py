"""Embedding near-dedup by NN-descent.

Every vector keeps a short list of its nearest neighbours. The lists start from blocks of a few
random projections and are refined by neighbours of neighbours: all vectors in the neighbourhood
of a node are compared with each other, and what is nearer than the end of a list enters it.
Lists that are full of linked neighbours (saturated) are enlarged. An audit measures recall against
brute force for a share of the vectors and asks for more rounds while it is too low. Edges at the threshold
give parts; inside a part all members are compared exactly, in blocks and in double precision,
so a group larger than any list loses no link. Copies of one vector count as one node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.blocks import compare_parts
from ledgerloom.llm.common import components, grouped_rows, prepare
from ledgerloom.session import materialize

THRESHOLD = 0.98
NEIGHBOURS = 8
ENLARGED = 4  # times NEIGHBOURS, for linked neighbours
BLOCK = 128  # vectors compared with each other at once
TARGET_RECALL = 0.98
AUDIT_SHARE = 20  # one vector of so many is a query of the audit, at least
AUDITED_GROUPS = 50  # groups that the linked queries of the audit stand for, if there are so many
AUDIT_BYTES = 32 << 20  # queries sent to the tasks at once
AUDIT_ROWS = 4096  # queries compared with a batch at once
DRAWS = 1 << 30
ROUNDS = 6  # an audit that is still too low after these rounds raises an error
SLACK = 1e-4  # of single precision, before the exact comparison

_BASE = pa.schema([("vec_id", pa.int64()), ("node", pa.binary()), ("space", pa.string()), ("vec", pa.binary())])
_EDGES = pa.schema([("u", pa.binary()), ("v", pa.binary()), ("sim", pa.float32())])
EDGE_SCHEMA = "u binary, v binary, sim float"


def _valid_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in double precision; ``space`` is label and dimension, NULL if not comparable."""
    for batch in batches:
        rows = []
        for vec_id, values, label in zip(*(c.to_pylist() for c in batch.columns)):
            row = {"vec_id": vec_id}
            if label is not None and values and None not in values:
                x = np.array(values, np.float64)
                top = np.abs(x).max()
                if np.isfinite(top) and top > 0:
                    x = x / top
                    unit = (x / np.sqrt(x @ x)).tobytes()
                    space = f"{len(values)}:{label}"
                    row |= {"node": hashlib.md5(space.encode() + b"|" + unit).digest(), "space": space, "vec": unit}
            rows.append(row)
        yield pa.RecordBatch.from_pylist(rows, schema=_BASE)


def _single(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.float32)


def _nearest(group: list[dict], k: int, reach: list[float] | None = None) -> Iterator[dict]:
    """The k nearest of each vector inside a group, only those nearer than its reach, if given."""
    x = np.stack([_single(r["vec32"]) for r in group])
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    k = min(k, len(group) - 1)
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < len(group) - 1 else np.argsort(-sims, axis=1)[:, :k]
    for i, row in enumerate(group):
        for j in best[i].tolist():
            if reach is None or sims[i, j] > reach[i]:
                yield {"u": row["node"], "v": group[j]["node"], "sim": float(sims[i, j])}


def _compare(key: list[str], k: int):
    """Task over groups sorted by ``key``; a row may carry the reach of its list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for _, group in grouped_rows(batches, key):
            if len(group) > 1:
                reach = [r["reach"] for r in group] if "reach" in group[0] else None
                rows += _nearest(group, k, reach)
            if len(rows) >= 5000:
                yield pa.RecordBatch.from_pylist(rows, schema=_EDGES)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, schema=_EDGES)

    return run


def _projected(table: int, seed: int):
    """Task that adds the projection code of a vector, about BLOCK vectors of its space to a code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            codes = []
            for data, in_space in zip(batch.column("vec32").to_pylist(), batch.column("in_space").to_pylist()):
                x = _single(data)
                bits = max(0, (in_space // BLOCK).bit_length())
                if len(x) not in planes:
                    planes[len(x)] = np.random.default_rng([seed, table, len(x)]).standard_normal((48, len(x)), np.float32)
                signs = planes[len(x)][:bits] @ x > 0
                codes.append(int(sum(1 << i for i, s in enumerate(signs.tolist()) if s)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("space"), batch.column("vec32"), pa.array(codes, pa.int64())],
                names=["node", "space", "vec32", "code"],
            )

    return run


def _seeded(nodes: DataFrame, tables: int, seed: int, k: int) -> DataFrame:
    """First neighbour lists from projection blocks; large codes are cut into several blocks."""
    lists = None
    for table in range(tables):
        coded = nodes.select("node", "space", "vec32", "in_space").mapInArrow(
            _projected(table, seed), "node binary, space string, vec32 binary, code long"
        )
        counted = coded.groupBy("space", "code").agg(F.ceil(F.count("*") / (2 * BLOCK)).alias("_n"))
        blocks = coded.join(counted, ["space", "code"]).withColumn("_cut", F.pmod(F.xxhash64("node", F.lit(seed)), F.col("_n")))
        key = ["space", "code", "_cut"]
        found = blocks.repartition(*key).sortWithinPartitions(*key, "node").mapInArrow(_compare(key, k), EDGE_SCHEMA)
        lists = found if lists is None else lists.union(found)
    return lists


def _best(edges: DataFrame, k: int, threshold: float) -> DataFrame:
    """The k nearest of each node; lists of linked neighbours are enlarged."""
    edges = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.col("sim").desc(), "v"))
    ranked = edges.withColumn("_rank", rank).filter(F.col("_rank") <= k * ENLARGED)
    return ranked.filter((F.col("_rank") <= k) | (F.col("sim") >= threshold)).drop("_rank")


def _descend(lists: DataFrame, nodes: DataFrame, k: int, seed: int) -> DataFrame:
    """Edges found among neighbours of neighbours."""
    forward = lists.select(F.col("u").alias("hub"), F.col("v").alias("node"))
    both = forward.union(lists.select(F.col("v").alias("hub"), F.col("u").alias("node"))).distinct()
    # A hub meets a hashed choice of its neighbours; what it leaves out is met at other hubs, in
    # later rounds and by the exact comparison inside parts.
    draw = F.row_number().over(Window.partitionBy("hub").orderBy(F.xxhash64("hub", "node", F.lit(seed))))
    both = both.withColumn("_draw", draw).filter(F.col("_draw") <= 2 * k).drop("_draw")
    reach = lists.groupBy("u").agg(F.count("*").alias("_n"), F.min("sim").alias("_end"))
    reach = reach.select(F.col("u").alias("node"), F.when(F.col("_n") >= k, F.col("_end")).otherwise(-2.0).cast("float").alias("reach"))
    known = nodes.select("node", "vec32").join(reach, "node", "left").fillna({"reach": -2.0})
    met = both.join(known, "node").repartition("hub").sortWithinPartitions("hub", "node")
    return met.select("hub", "node", "vec32", "reach").mapInArrow(_compare(["hub"], k), EDGE_SCHEMA)


def _tally(queries: list, threshold: float):
    """Task that sums per query vector (its place in ``queries``) the links and those inside its part."""
    spaces: dict[str, list[int]] = {}
    for i, row in enumerate(queries):
        spaces.setdefault(row["space"], []).append(i)
    held = {
        space: (
            np.array(at), np.stack([_single(queries[i]["vec32"]) for i in at]),
            np.array([queries[i]["id"] for i in at]), np.array([queries[i]["part"] for i in at]),
        )
        for space, at in spaces.items()
    }
    total = len(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, met = np.zeros(total, np.int64), np.zeros(total, np.int64)
        for batch in batches:
            names = np.array(batch.column("space").to_pylist(), object)
            vectors = batch.column("vec32").to_pylist()
            ids, parts = (batch.column(c).to_numpy() for c in ("id", "part"))
            for space in set(names.tolist()) & held.keys():
                mine = np.flatnonzero(names == space)
                y = np.stack([_single(vectors[i]) for i in mine])
                places, x, own, own_part = held[space]
                for low in range(0, len(x), AUDIT_ROWS):
                    near = np.flatnonzero(x[low : low + AUDIT_ROWS] @ y.T >= threshold)
                    q, r = near // len(y) + low, mine[near % len(y)]
                    other = own[q] != ids[r]
                    q, r = q[other], r[other]
                    wanted[places] += np.bincount(q, minlength=len(x))
                    met[places] += np.bincount(q[own_part[q] == parts[r]], minlength=len(x))
        at = np.flatnonzero(wanted)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(wanted[at]), pa.array(met[at])], names=["q", "wanted", "met"])

    return run


def _recall(nodes: DataFrame, parts: DataFrame, threshold: float) -> float:
    """Share of the links of hash-chosen query vectors that stay inside parts, by brute force against all nodes.

    One vector of AUDIT_SHARE is a query; the set is enlarged until the linked ones stand for AUDITED_GROUPS
    groups or all vectors are queries. The lower of two averages counts: each linked query alike,
    and each weighted as its share of its group, so that a large group does not cover for small ones.
    Queries move in slices of a fixed size; links are summed where they are found.
    """
    placed = nodes.join(parts.select("node", "component"), "node", "left")
    # A vector without links is a part of its own.
    part = F.when(F.col("component").isNull(), F.xxhash64("node")).otherwise(F.xxhash64("component"))
    placed = materialize(placed.select("space", "vec32", F.xxhash64("node").alias("id"), part.alias("part")), "audited")
    drawn = F.pmod(F.xxhash64("id", F.lit("audit")), F.lit(DRAWS))
    low, high = 0, DRAWS // AUDIT_SHARE
    linked, recalled, groups, kept = 0, 0.0, 0.0, 0.0
    while low < DRAWS:
        chosen = placed.filter((drawn >= low) & (drawn < high))
        size = chosen.agg(F.coalesce(F.sum(F.length("vec32") + 100), F.lit(0))).first()[0]
        slices = -(-size // AUDIT_BYTES)
        for i in range(slices):
            queries = chosen.filter(F.pmod(F.xxhash64("id", F.lit("slice")), F.lit(slices)) == i).collect()
            if not queries:
                continue
            tallied = placed.mapInArrow(_tally(queries, threshold), "q long, wanted long, met long")
            tallied = tallied.groupBy("q").agg(F.sum("wanted").alias("wanted"), F.sum("met").alias("met"))
            share, weight = F.col("met") / F.col("wanted"), 1 / (F.col("wanted") + 1)
            row = tallied.agg(F.count("*"), F.sum(share), F.sum(weight), F.sum(share * weight)).first()
            if row[0]:
                linked, recalled, groups, kept = linked + row[0], recalled + row[1], groups + row[2], kept + row[3]
        if groups >= AUDITED_GROUPS:
            break
        low, high = high, min(DRAWS, high * 4)
    # Without a link here all vectors were queries, so there is none to find.
    return min(recalled / linked, kept / groups) if linked else 1.0


def link_embeddings(
    embeddings: DataFrame, threshold: float = THRESHOLD, k: int = NEIGHBOURS, target: float = TARGET_RECALL, seed: int = 11
) -> DataFrame:
    """n_links, component_id and kept of each row of ``embeddings`` (vec_id, embedding, label).

    Rows are linked at a cosine of ``threshold`` or more if their labels are equal. NULL labels,
    NULL, empty or zero vectors and vectors with a NULL or non-finite component link with nothing,
    as do vectors of different dimensions. ``n_links`` counts the other rows linked directly,
    copies of the same vector included; ``component_id`` is the smallest vec_id that links reach.
    Rows of one vec_id are all kept; an empty table gives an empty result.
    """
    prepare(embeddings.sparkSession)
    rows = embeddings.select("vec_id", "embedding", F.col("label").cast("string").alias("label"))
    base = materialize(rows.mapInArrow(_valid_vectors, "vec_id long, node binary, space string, vec binary"), "vectors")
    classes = base.filter("node is not null").groupBy("node").agg(
        F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.min("space").alias("space"), F.min("vec").alias("vec")
    )
    sizes = base.filter("space is not null").groupBy("space").agg(F.count("*").alias("in_space"))
    nodes = classes.join(sizes, "space").mapInArrow(_with_single, _NODE_SCHEMA)
    nodes = materialize(nodes, "nodes")

    lists = materialize(_best(_seeded(nodes, 3, seed, k), k, threshold - SLACK), "lists")
    for turn in range(1, ROUNDS + 1):
        found = _descend(lists, nodes, k, seed + turn)
        if turn > 1:
            found = found.union(_seeded(nodes, 2, seed + 100 * turn, k))
        lists = materialize(_best(lists.union(found), k, threshold - SLACK), "lists")
        parts = components(lists.filter(F.col("sim") >= threshold - SLACK), "u", "v")
        if _recall(nodes, parts, threshold + SLACK) >= target:
            break
    else:
        raise RuntimeError(f"recall stays below {target} after {ROUNDS} rounds")

    members = parts.select("node", F.col("component").alias("part")).join(nodes, "node")
    members = members.select("part", "node", "copies", F.col("vec").alias("payload"))

    def linked(a: list[bytes], b: list[bytes]) -> np.ndarray:
        x, y = (np.stack([np.frombuffer(v, np.float64) for v in side]) for side in (a, b))
        return x @ y.T >= threshold

    exact = materialize(compare_parts(members, linked, 1024), "exact")
    links = exact.filter("other is null").groupBy("node").agg(F.sum("n").alias("_links"))
    joined = components(exact.filter("other is not null"), "node", "other")
    smallest = joined.join(nodes.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("_smallest"))
    known = (
        nodes.select("node", "first", "copies")
        .join(links, "node", "left")
        .join(joined.join(smallest, "component").select("node", "_smallest"), "node", "left")
    )
    out = base.select("vec_id", "node").join(known, "node", "left")
    component = F.coalesce("_smallest", "first", "vec_id")
    return out.select(
        "vec_id",
        (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("_links", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


_NODE_SCHEMA = "space string, node binary, first long, copies long, vec binary, in_space long, vec32 binary"


def _with_single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        single = [np.frombuffer(v, np.float64).astype(np.float32).tobytes() for v in batch.column("vec").to_pylist()]
        yield pa.RecordBatch.from_arrays(batch.columns + [pa.array(single, pa.binary())], names=batch.schema.names + ["vec32"])
