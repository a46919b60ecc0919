"""Merkle manifest of a data set, folded by SHA midstates.

Every 16 consecutive nodes become their parent's SHA-256. While a parent is hashed, the state
before each child slot is copied and kept. To replace one child, its slot's copy is resumed with
the replacement and the right siblings only; the left siblings are never hashed again.

Leaves are ranked within their source. Three levels, 4,096 nodes, form a block that one task
holds; the roots of the blocks are the nodes of the next tier, until one node is left, and the
sources' roots form a last tree in the same way. Going down, each block receives the path of its
root: per level the siblings to the left and to the right. A task hashes a path's left siblings
once, keeps those states, and folds all leaves of its block through copies of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import grouped_rows, prepare
from ledgerloom.llm.ranks import ranked
from ledgerloom.session import materialize

FAN = 16
LEVELS = 3  # of one block
BLOCK = FAN**LEVELS
TREE = ["_null", "_name"]  # a source, told apart from NULL
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# ---- one block, inside a task ----------------------------------------------------------------


def depth_of(nodes: int) -> int:
    """Levels above a row of nodes."""
    depth = 0
    while nodes > 1:
        nodes, depth = -(-nodes // FAN), depth + 1
    return depth


def grow(nodes: list[bytes], levels: int) -> tuple[list[list[tuple[list[bytes], list]]], list[bytes]]:
    """Parents of each level as (children, states before each child slot), and the top nodes."""
    grown = []
    for _ in range(levels):
        parents, tops = [], []
        for first in range(0, len(nodes), FAN):
            run, states, h = nodes[first : first + FAN], [], sha256()
            for child in run:
                states.append(h.copy())
                h.update(child)
            parents.append((run, states))
            tops.append(h.hexdigest().encode())
        grown.append(parents)
        nodes = tops
    return grown, nodes


def resume(state, replacement: bytes, right: bytes) -> bytes:
    """Digest of a parent from the state before a slot, the slot's new child and what follows."""
    h = state.copy()
    h.update(replacement)
    h.update(right)
    return h.hexdigest().encode()


def siblings(grown, at: int) -> list[tuple[bytes, bytes]]:
    """Left and right siblings of node ``at`` and of its ancestors in a block."""
    out = []
    for parents in grown:
        run, slot = parents[at // FAN][0], at % FAN
        out.append((b"".join(run[:slot]), b"".join(run[slot + 1 :])))
        at //= FAN
    return out


def fold(grown, at: int, leaf: bytes) -> bytes:
    """Top node of a block in which node ``at`` is ``leaf``."""
    for parents in grown:
        run, states = parents[at // FAN]
        leaf = resume(states[at % FAN], leaf, b"".join(run[at % FAN + 1 :]))
        at //= FAN
    return leaf


# ---- tiers of blocks ---------------------------------------------------------------------------

_KEYS = [*TREE, "_block"]
_NODES = "_null boolean, _name string, _at long, _n long, digest string"
_PATHS = "_null boolean, _name string, _at long, lefts array<string>, rights array<string>"


def _levels(n: int) -> int:
    return min(LEVELS, depth_of(n))


def _table(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("_null", pa.bool_()), ("_name", pa.string()), ("_at", pa.int64()), ("_n", pa.int64()), ("digest", pa.string())])
    for (null, name, block), rows in grouped_rows(batches, _KEYS):
        n = rows[0]["_n"]
        _, (top,) = grow([r["digest"].encode() for r in rows], _levels(n))
        yield _table([{"_null": null, "_name": name, "_at": block, "_n": -(-n // BLOCK), "digest": top.decode()}], schema)


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("_block", F.expr(f"_at div {BLOCK}"))


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Stored tiers of trees (_null, _name, _at, _n, digest): the given nodes, the roots of their
    blocks, and so on up to one node for each tree. ``_n`` is the number of nodes of the tree."""
    tiers = [nodes]
    while (tiers[-1].agg(F.max("_n")).first()[0] or 0) > 1:
        rows = _blocks(tiers[-1]).select(*_KEYS, "_at", "_n", "digest")
        rows = rows.repartition(*map(F.col, _KEYS)).sortWithinPartitions(*_KEYS, "_at")
        tiers.append(materialize(rows.mapInArrow(_tops, _NODES), "tier"))
    return tiers


def _with_paths(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows of each block in order, with the path of the block's root as the block's first row."""
    nodes = _blocks(nodes)
    above = paths.withColumnRenamed("_at", "_block")
    both = nodes.unionByName(above, allowMissingColumns=True)
    return both.repartition(*map(F.col, _KEYS)).sortWithinPartitions(*_KEYS, F.col("_at").asc_nulls_first())


def _downward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts = pa.list_(pa.string())
    schema = pa.schema([("_null", pa.bool_()), ("_name", pa.string()), ("_at", pa.int64()), ("lefts", texts), ("rights", texts)])
    for (null, name, block), (path, *rows) in grouped_rows(batches, _KEYS):
        grown, _ = grow([r["digest"].encode() for r in rows], _levels(rows[0]["_n"]))
        for first in range(0, len(rows), FAN):
            out = []
            for at in range(first, min(first + FAN, len(rows))):
                own = siblings(grown, at)
                out.append({
                    "_null": null, "_name": name, "_at": block * BLOCK + at,
                    "lefts": [left.decode() for left, _ in own] + path["lefts"],
                    "rights": [right.decode() for _, right in own] + path["rights"],
                })
            yield _table(out, schema)


def descend(tiers: list[DataFrame], top: DataFrame) -> DataFrame:
    """Paths (_null, _name, _at, lefts, rights) of the first tier's nodes, given those of the
    trees' roots."""
    for tier in reversed(tiers[:-1]):
        rows = _with_paths(tier, top)
        top = materialize(rows.mapInArrow(_downward, _PATHS), "paths")
    return top


# ---- leaves and the manifest -------------------------------------------------------------------


def leaf_digest(text: Column | None = None) -> Column:
    """SHA-256 of the fields of a document row, each ``-`` if NULL, else byte count, ``:``, value."""
    parts = []
    for name in FIELDS:
        value = (F.col(name) if text is None or name != "text" else text).cast("string")
        marked = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
        parts.append(F.coalesce(marked, F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _folded(proofs: bool):
    fields = [("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
              ("proof_sha256", pa.string()), ("folded_root", pa.string())]
    fields += [("source", pa.string()), ("position", pa.int64())]
    fields += [("proof", pa.list_(pa.string()))] * proofs
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (null, name, block), (path, *rows) in grouped_rows(batches, _KEYS):
            grown, (top,) = grow([r["digest"].encode() for r in rows], _levels(rows[0]["_n"]))
            rights = [right.encode() for right in path["rights"]]
            above = [left.encode() + right for left, right in zip(path["lefts"], rights, strict=True)]
            # States before the slots of the block's root and its ancestors, kept for all leaves.
            states = [sha256(left.encode()) for left in path["lefts"]]
            out = []
            for at, row in enumerate(rows):
                node = fold(grown, at, (row["replacement"] or row["digest"]).encode())
                for state, right in zip(states, rights, strict=True):
                    node = resume(state, node, right)
                around = [left + right for left, right in siblings(grown, at)] + above
                out.append({
                    "doc_id": row["doc_id"], "leaf": row["digest"], "subroot": path["subroot"], "root": path["root"],
                    "proof_sha256": sha256(b"".join(around)).hexdigest(), "folded_root": node.decode(),
                    "source": None if null else name, "position": block * BLOCK + at,
                })
                if proofs:
                    out[-1]["proof"] = [part.decode() for part in around]
                if len(out) == 512:
                    yield _table(out, schema)
                    out = []
            if out:
                yield _table(out, schema)

    return run


def build_manifest(leaves: DataFrame, proofs: bool = False) -> DataFrame:
    """One row per leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root, source, position.

    ``leaves`` has doc_id (long), source, leaf and replacement (hex digests). In each source leaves
    ascend by doc_id, NULL first, and equal doc_ids by leaf. ``proof_sha256`` is the hash of all
    siblings from the leaf's run up to the root; with ``proofs`` they are also listed by level.
    ``folded_root`` is the root with the leaf's replacement in its place, or with the leaf itself
    where that is NULL. NULL is a source of its own, before all others. Repeated rows are leaves
    of their own. An empty table gives an empty manifest. Other columns are not read.
    """
    spark = prepare(leaves.sparkSession)
    rows = leaves.select(
        "doc_id",
        F.col("source").isNull().alias("_null"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_name"),
        F.col("leaf").alias("digest"),
        "replacement",
    )
    rows = materialize(ranked(materialize(rows, "leaves"), TREE, ["doc_id", "digest"], "_at", "_n"), "ranked_leaves")
    if rows.isEmpty():
        empty = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, source string, position long"
        return spark.createDataFrame([], empty + ", proof array<string>" * proofs)

    tiers = climb(rows)
    subroots = tiers[-1].select("_null", "_name", F.col("digest").alias("subroot"))
    # The sources' roots are the nodes of one last tree, NULL first.
    forest = subroots.select((~F.col("_null")).cast("int").alias("named"), "_null", "_name", F.col("subroot").alias("digest"))
    forest = ranked(materialize(forest, "subroots"), [], ["named", "_name"], "_at", "_n").select(
        F.col("_null").alias("null"), F.col("_name").alias("name"), F.lit(False).alias("_null"), F.lit("").alias("_name"), "_at", "_n", "digest"
    )
    forest = materialize(forest, "forest")
    above = climb(forest.select("_null", "_name", "_at", "_n", "digest"))
    none = F.array().cast("array<string>")
    top = spark.range(1).select(
        F.lit(False).alias("_null"), F.lit("").alias("_name"), F.lit(0).cast("long").alias("_at"), none.alias("lefts"), none.alias("rights")
    )
    root = above[-1].first()["digest"]
    places = descend(above, top).select("_at", "lefts", "rights")
    heads = forest.join(places, "_at").select(
        F.col("null").alias("_null"), F.col("name").alias("_name"), F.lit(0).cast("long").alias("_at"), "lefts", "rights"
    )
    # A source whose leaves need one block only has that block's root as its last node.
    paths = descend(tiers[1:], heads) if len(tiers) > 1 else heads
    paths = paths.join(subroots, TREE).withColumn("root", F.lit(root))
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, source string, position long"
    return _with_paths(rows, paths).mapInArrow(_folded(proofs), schema + ", proof array<string>" * proofs)


def document_leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """Leaves of document rows; where ``tampered`` holds, the replacement is the leaf of the row
    with its text's A-Z lower-cased."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.select(
        "doc_id", "source", leaf_digest().alias("leaf"), F.when(tampered, leaf_digest(lowered)).alias("replacement")
    )


def chosen_rows(every: int = 5) -> Column:
    """Rows whose decimal doc_id has a crc32 divisible by ``every``; never those without doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, F.lit(False))
