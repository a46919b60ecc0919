"""Language ID: multinomial naive Bayes over hashed character n-grams.

Characters are lower-cased; everything but letters is one separator. Counts of 1- to 3-grams per
language are summed over the training rows by Spark, and the matrix of log-probabilities (its
size is fixed by ``MODEL_BYTES``) goes to the tasks. Whole texts are scored in numpy, one Arrow
batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import prepare

TRAIN_ROWS = 20_000  # documented bound of the sample of labelled rows that the classifier learns from
BUCKETS = 1 << 15  # n-gram buckets, fewer if there are very many languages
MODEL_BYTES = 64 << 20
ALPHA = 0.5
ORDERS = (1, 2, 3)
FOLDS = 5
_PIECE = 1 << 19  # characters scored at once
_SALTS = tuple(np.uint64(s) for s in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """True at the code points that are letters; built once per worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def codes_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts as numbers, 0 for the rest, and the start of each text.

    Two zeros stand before each text, so no n-gram spans two texts.
    """
    lowered = [(t or "").lower() for t in texts]
    joined = "".join("\0\0" + t for t in lowered)
    raw = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    sizes = [2 + len(t) for t in lowered]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    return np.where(letter_table()[raw], raw, 0).astype(np.uint64), starts


def buckets_of(codes: np.ndarray, order: int, buckets: int, a: int, b: int) -> np.ndarray:
    """Bucket of the n-gram that ends at each place of [a, b); ``buckets`` if it has no letter."""
    padded = codes[max(0, a - order + 1) : b]
    if a < order - 1:
        padded = np.concatenate([np.zeros(order - 1 - a, np.uint64), padded])
    n = b - a
    h = np.zeros(n, np.uint64)
    seen = np.zeros(n, np.uint64)
    for j in range(order):
        part = padded[j : j + n]
        h = (h + part) * _SALTS[order - 1]
        seen |= part
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    return np.where(seen != 0, (h ^ (h >> np.uint64(29))) * _SALTS[0] >> shift, np.uint64(buckets)).astype(np.int64)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo the folds, is 0; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # (buckets + 1, languages); the last row is zero
    prior: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not texts:
            return [], []
        codes, starts = codes_of(texts)
        totals = np.tile(self.prior, (len(texts), 1))
        letters = np.add.reduceat((codes != 0).astype(np.int64), starts)
        buckets = len(self.logs) - 1
        for a in range(0, len(codes), _PIECE):
            b = min(a + _PIECE, len(codes))
            first = int(np.searchsorted(starts, a, "right")) - 1
            inner = starts[(starts > a) & (starts < b)]
            cuts = np.concatenate([[a], inner]) - a
            for order in ORDERS:
                values = self.logs[buckets_of(codes, order, buckets, a, b)]
                totals[first : first + len(cuts)] += np.add.reduceat(values, cuts, axis=0, dtype=np.float64)
        best = totals.argmax(axis=1)
        share = np.exp(totals - totals.max(axis=1, keepdims=True))
        score = share.max(axis=1) / share.sum(axis=1)
        found = [bool(n) for n in letters]
        return (
            [self.languages[i] if ok else "und" for i, ok in zip(best.tolist(), found)],
            [s if ok else 0.0 for s, ok in zip(score.tolist(), found)],
        )


def train(documents: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """Model of the rows that are not held out and have a language; None without such a row.

    Above ``rows`` labelled rows a hash sample of about that many is used, with whole texts.
    """
    prepare(documents.sparkSession)
    labelled = documents.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    labelled = labelled.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    total = labelled.count()
    if not total:
        return None
    share = min(1.0, rows / total)
    picked = labelled.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    picked = picked.select("lang", "text")
    sizes = {r["lang"]: r["n"] for r in picked.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    buckets = BUCKETS
    while buckets > 256 and buckets * len(languages) * 4 > MODEL_BYTES:
        buckets //= 2
    number = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                codes, _ = codes_of([t for x, t in zip(langs, texts) if x == lang])
                mine = sums.setdefault(number[lang], np.zeros(buckets + 1, np.int64))
                for a in range(0, len(codes), _PIECE):
                    for order in ORDERS:
                        b = min(a + _PIECE, len(codes))
                        mine += np.bincount(buckets_of(codes, order, buckets, a, b), minlength=buckets + 1)
        for lang, mine in sums.items():
            at = np.flatnonzero(mine[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), lang, np.int32)), pa.array(at.astype(np.int32)), pa.array(mine[at])],
                names=["lang", "bucket", "n"],
            )

    counted = picked.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    counts = np.zeros((buckets, len(languages)))
    counts[table["bucket"].to_numpy(), table["lang"].to_numpy()] = table["n"].to_numpy()
    logs = np.log((counts + ALPHA) / (counts.sum(axis=0) + ALPHA * buckets))
    prior = np.log(np.array([sizes[x] for x in languages]) / sum(sizes.values()))
    return Model(languages, np.vstack([logs, np.zeros(len(languages))]).astype(np.float32), prior)


def predict_languages(documents: DataFrame, model: Model | None) -> DataFrame:
    """Language of each row of ``documents`` (doc_id, text) with its posterior as ``score``.

    NULL, empty and letterless texts are ``und`` with score 0, as is everything without a model.
    Rows of repeated or NULL doc_ids are all predicted. Only the text is an input of a prediction;
    other columns are not read.
    """
    prepare(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            langs, scores = model.predict(texts) if model else (["und"] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                schema=_ARROW,
            )

    return documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, SCHEMA)


def keep_identified(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose language is identified with a score of at least ``least``, with all
    their columns, in one narrow pass."""
    prepare(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            langs, scores = model.predict(texts) if model else (["und"] * len(texts), [0.0] * len(texts))
            keep = [lang != "und" and score >= least for lang, score in zip(langs, scores)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
