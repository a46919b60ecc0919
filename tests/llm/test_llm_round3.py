"""Sharding, spelling variants and the Merkle manifest against brute force, and their edge cases."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from hashlib import md5, sha256
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import merkle, ranks, sharding, spelling
from ledgerloom.session import materialize

LONG = "Repeating the wonderful sentences " * 20_000
EDGE = [
    (1, None, None, None, None),
    (2, "", "en", "s1", 0),
    (3, "### \n!!", "en", "s1", 7),
    (4, "Wonderful SENTENCES, wonderfull sentencesé", "en", None, 40),
    (4, "Wonderful SENTENCES, wonderfull sentencesé", "en", None, 40),
    (None, "another sentence of seven words is here", "en", "s2", None),
    (None, "another sentence of seven words is here", "en", "s2", None),
    (None, "yet another one", "en", "s2", 15),
    (5, LONG, "en", "s2", len(LONG)),
    (6, "café 日本 \U0001f600 repeeting", "fr", "", 20),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def edge(spark):
    df = spark.createDataFrame(EDGE, COLUMNS).repartition(3)
    clash = ["shard", "slot", "size", "leaf", "digest", "replacement", "run", "word", "n", "h", "_key", "_row", "_at", "_piece"]
    return df.withColumns({c: F.lit("x") for c in clash})


@pytest.fixture(scope="module")
def nothing(edge):
    return edge.filter("false")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# ---- positions -----------------------------------------------------------------------------


def test_positions_span_pieces(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ROWS_PER_PIECE", 7)
    df = spark.range(200).select((F.col("id") % 3 == 0).alias("g"), (F.col("id") * 37 % 101).alias("k"), "id")
    rows = ranks.ranked(materialize(df, "t"), ["g"], ["k", "id"], "at", "of").collect()
    for g in (True, False):
        group = sorted((r for r in rows if r["g"] == g), key=lambda r: (r["k"], r["id"]))
        assert [r["at"] for r in group] == list(range(len(group))) and {r["of"] for r in group} == {len(group)}


# ---- sharding --------------------------------------------------------------------------------


def brute_shards(rows, shards, seed):
    def mark(v):
        return "-" if v is None else f"={v}"

    def digest(text):
        return md5(text.encode()).hexdigest()

    keyed = []
    for doc_id, text, source in rows:
        key = digest("|".join([str(seed), mark(doc_id), mark(source), mark(None if text is None else digest(text))]))
        keyed.append((source, key, doc_id, text))
    order = []
    groups = defaultdict(list)
    for row in keyed:
        groups[row[0]].append(row)
    for source, members in groups.items():
        start = int(digest(f"{seed}:{source or ''}")[:13], 16) / 2**52
        for nth, row in enumerate(sorted(members, key=lambda r: r[1])):
            order.append(((nth + start) / len(members), row[1], row))
    order.sort(key=lambda r: r[:2])
    out, used = [], Counter()
    for at, (_, _, (source, _, doc_id, text)) in enumerate(order):
        shard = at * shards // len(order)
        data = (text or "").encode()
        out.append((doc_id, len(data) + 1, zlib.crc32(data), "rows", shard, used[shard], None))
        used[shard] += 1
    return out


def test_shards_equal_brute_force(spark, edge, documents, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_PIECE", 20)
    for name, df in (("docs", documents), ("edge", edge)):
        want = Counter(brute_shards(df.select("doc_id", "text", "source").collect(), 8, 11))
        report = sharding.shard_report(sharding.write_shards(df, str(tmp_path / name)))
        assert Counter(map(tuple, report.collect())) == want
        counts = Counter(r[4] for r in want)
        assert max(counts.values()) - min(counts.values()) <= 1


def test_shards_match_the_mixture(documents):
    rows = sharding.place_documents(documents).collect()
    whole = Counter(r["source"] for r in rows)
    for shard in range(8):
        mine = Counter(r["source"] for r in rows if r["shard"] == shard)
        assert all(abs(mine[s] - whole[s] / 8) < 2 for s in whole)


def test_shard_files_hold_whole_rows_in_slot_order(spark, edge, tmp_path):
    stored = sharding.write_shards(edge, str(tmp_path / "s"), shards=3)
    assert stored.columns == [c for c in edge.columns if c not in ("shard", "slot")] + ["slot", "shard"]
    got = Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in stored.collect())
    assert got == Counter(EDGE)
    for file in Path(tmp_path / "s").rglob("*.parquet"):
        slots = pq.read_table(file)["slot"].to_pylist()
        assert slots == sorted(slots)


def test_shards_of_few_and_of_no_rows(spark, nothing, tmp_path):
    assert sharding.write_shards(nothing, str(tmp_path / "none")).count() == 0
    one = spark.createDataFrame([(1, "a", None, None, 1)], COLUMNS)
    (row,) = sharding.shard_report(sharding.write_shards(one, str(tmp_path / "one"))).collect()
    assert (row["shard"], row["slot"], row["grown_shard"]) == (0, 0, None)


# ---- spelling variants -----------------------------------------------------------------------


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def brute_variants(counts):
    rows = {}
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= 10 * n else None
        rows[w] = (form, n, len(near[w]), counts[best] if form else None)
    out = set()
    for w, (form, n, n_near, form_n) in rows.items():
        root = w
        while rows[root][0] is not None:
            root = rows[root][0]
        out.add((w, form, root, n, n_near, form_n))
    return out


def random_words(seed=3, n=300):
    rng, words = random.Random(seed), {}
    while len(words) < n:
        w = "".join(rng.choice("abé") for _ in range(rng.randint(7, 10)))
        words[w] = rng.choice((2, 3, 30, 500, 9000))
    return words


@pytest.mark.parametrize("most_pairs", [10_000, 20, 0])
def test_variants_equal_brute_force(spark, most_pairs):
    counts = random_words()
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {tuple(r) for r in spelling.group_variants(df, most_pairs=most_pairs).collect()}
    assert got == brute_variants(counts)


def test_a_chunk_shared_by_all_words(spark):
    """Every word starts alike: the chunk is not cut, its words meet by one-gap patterns."""
    rng = random.Random(5)
    counts = {"commonstart" + "".join(rng.choice("abc") for _ in range(11)): 2 for _ in range(400)}
    counts |= {w[:13] + w[14:]: 50 for w in list(counts)[:100]}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {tuple(r) for r in spelling.group_variants(df, most_pairs=500).collect()} == brute_variants(counts)


def test_word_counts_equal_brute_force(spark, edge):
    import re

    want = Counter()
    for doc_id, text, *_ in EDGE:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 3 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += len(run) >= 7
    got = {r["word"]: r["n"] for r in spelling.word_counts(edge, damage=3).collect()}
    assert got == {w: n for w, n in want.items() if n >= 2}


def test_chain_of_forms_and_nothing(spark, nothing):
    counts = {"abcdefgh": 2, "abcdefghi": 20, "abcdefghij": 200, "abcdefghijk": 2000, "abcdefghijkl": 30_000}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {r["root"] for r in spelling.group_variants(df).collect()} == {"abcdefghijkl"}
    assert spelling.group_variants(spelling.word_counts(nothing)).collect() == []


# ---- Merkle manifest -------------------------------------------------------------------------


def sha(data: bytes) -> bytes:
    return sha256(data).hexdigest().encode()


def brute_tree(nodes):
    """Root, and for each node its siblings level by level with its slot."""
    paths = [[] for _ in nodes]
    at, row = list(range(len(nodes))), nodes
    while len(row) > 1:
        runs = [row[i : i + 16] for i in range(0, len(row), 16)]
        for leaf, place in enumerate(at):
            run, slot = runs[place // 16], place % 16
            paths[leaf].append((b"".join(run[:slot]), b"".join(run[slot + 1 :])))
            at[leaf] = place // 16
        row = [sha(b"".join(run)) for run in runs]
    return row[0], paths


def brute_manifest(rows):
    """rows: (doc_id, source, leaf, replacement)."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        trees[s] = brute_tree([r[2].encode() for r in groups[s]])
    root, above = brute_tree([trees[s][0] for s in names])
    out = Counter()
    for s, up in zip(names, above, strict=True):
        for (doc_id, _, leaf, replacement), path in zip(groups[s], trees[s][1], strict=True):
            node = (replacement or leaf).encode()
            for left, right in path + up:
                node = sha(left + node + right)
            proof = sha(b"".join(left + right for left, right in path + up))
            out[doc_id, leaf, trees[s][0].decode(), root.decode(), proof.decode(), node.decode()] += 1
    return out


def brute_leaf(row, text):
    parts = []
    for value in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text):
        parts.append("-" if value is None else f"{len(str(value).encode())}:{value}")
    return sha256("".join(parts).encode()).hexdigest()


def rows_of(manifest):
    return Counter(
        tuple(r) for r in manifest.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root").collect()
    )


def test_manifest_equals_brute_force(edge, documents):
    for df in (documents, edge):
        rows = []
        for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect():
            chosen = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            changed = None if r["text"] is None else lowered(r["text"])
            rows.append((r["doc_id"], r["source"], brute_leaf(r, r["text"]), brute_leaf(r, changed) if chosen else None))
        manifest = merkle.build_manifest(merkle.document_leaves(df, merkle.chosen_rows(5)))
        assert rows_of(manifest) == brute_manifest(rows)


def test_manifest_of_several_tiers(spark):
    """Blocks over blocks, a source that ends early, and more sources than one run holds."""
    sizes = {None: 17, "big": 4096 * 17 + 1, "block": 4096, "one": 1} | {f"s{i}": i + 1 for i in range(20)}
    rows = [(i, s, sha256(f"{s}:{i}".encode()).hexdigest(), sha256(b"x").hexdigest() if i % 7 == 0 else None)
            for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, leaf string, replacement string").repartition(5)
    manifest = merkle.build_manifest(df)
    assert rows_of(manifest) == brute_manifest(rows)


def test_proofs_are_listed_and_nothing_gives_nothing(spark, nothing):
    rows = [(i, "s", sha256(str(i).encode()).hexdigest(), None) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, leaf string, replacement string")
    for r in merkle.build_manifest(df, proofs=True).collect():
        assert sha256("".join(r["proof"]).encode()).hexdigest() == r["proof_sha256"] and r["folded_root"] == r["root"] == r["subroot"]
        assert len(r["proof"]) == 3
    leaves = merkle.document_leaves(nothing, merkle.chosen_rows())
    assert merkle.build_manifest(leaves).collect() == [] and merkle.build_manifest(leaves, proofs=True).collect() == []


def test_midstates_skip_the_left_siblings():
    nodes = [sha(str(i).encode()) for i in range(40)]
    grown, (top,) = merkle.grow(nodes, 2)
    assert brute_tree(nodes)[0] == top
    for at in (0, 15, 16, 39):
        changed = [*nodes[:at], sha(b"new"), *nodes[at + 1 :]]
        assert merkle.fold(grown, at, sha(b"new")) == brute_tree(changed)[0]
        assert merkle.fold(grown, at, nodes[at]) == top  # kept states are copied, never used up


# ---- mixing ----------------------------------------------------------------------------------


def test_mixing_rows_without_ids(spark):
    """Rows of one doc_id, or of none, are told apart by text and source; equal ones by number."""
    from ledgerloom.llm import mixing

    many = spark.range(30_000).select(
        F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("some words "), F.col("id") % 20_000).alias("text"),
        F.lit("s").alias("source"), F.col("id").alias("extra"),
    )
    got = mixing.mixed_documents(many)
    taken = mixing.mix_sources(many).agg(F.sum("copies")).first()[0]
    assert got.count() == taken == 30_000 and got.select("extra").distinct().count() == 30_000
    assert got.columns == many.columns


def test_pipeline_runs_on_odd_rows(spark, edge, nothing, tmp_path):
    """NULLs, empty and very long texts, repeated rows, clashing columns, and no rows at all."""
    import corpus_pipeline

    benchmark = spark.createDataFrame([(1, "seven words is here"), (2, None), (3, "")], "item_id long, text string")
    clash = edge.drop("_key", "_row", "_at", "_piece")
    for name, docs in (("odd", clash), ("none", clash.filter("false"))):
        folder = tmp_path / name
        docs.write.parquet(str(folder / "documents.parquet"))
        benchmark.write.parquet(str(folder / "benchmark.parquet"))
        rows = sorted(corpus_pipeline.run(spark, str(folder)).collect(), key=lambda r: r["start"])
        assert [r["start"] for r in rows] == [sum(r["n_tokens"] for r in rows[:i]) for i in range(len(rows))]
        assert all(r["n_tokens"] > 1 for r in rows) and not {r["doc_id"] for r in rows} & {1, 2, 3}
        assert bool(rows) == (name == "odd")
