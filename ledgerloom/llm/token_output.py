"""Token-ID output: tokenize, code and write documents in doc_id order, and read them back.

A token table is a Parquet table whose rows are chunks. A chunk holds whole documents in order:
their ids, their numbers of tokens and one coded payload (``token_coder``). Parquet is only the
container, so any storage that Spark writes to will do, and a lost task is written again by
Spark's own commit protocol.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm import token_coder
from ledgerloom.llm.common import prepare
from ledgerloom.session import new_folder

END_ID = 2
CHUNK_TOKENS = 2_000_000
PARTITION_BYTES = 20 << 20  # of text; a few chunks each
CACHED_WORDS = 300_000
CACHED_CHARACTERS = 16 << 20
GROUP_CHARACTERS = 1 << 20

FILE_SCHEMA = "part int, chunk int, before long, doc_ids array<long>, sizes array<long>, payload binary"
_FILE_ARROW = pa.schema(
    [("part", pa.int32()), ("chunk", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64()))]
    + [("sizes", pa.list_(pa.int64())), ("payload", pa.binary())]
)
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"

# The tokenizer never joins characters across white space, so in texts of plain characters each
# word is encoded by itself and a repeated word once; other texts go to the tokenizer as a whole.
_NOT_PLAIN = re.compile("[^\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]|<\\|")
_PIECES = re.compile(r"'(?:[stmd]|re|ve|ll)|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


class _Known:
    """Token ids of keys, bounded in keys and in characters.

    When it is full, keys that were used again since the last time stay, the oldest first, up to half
    of the bounds: rare keys make room and frequent ones are not learned again.
    """

    def __init__(self) -> None:
        self.places: dict[str, int] = {}
        self.characters = self.used = 0
        self.starts, self.sizes = np.empty(1024, np.int64), np.empty(1024, np.int64)
        self.again = np.zeros(1024, bool)
        self.ids = np.empty(4096, np.uint32)

    def find(self, keys: list[str]) -> np.ndarray:
        """The place of each key, -1 if it is not known."""
        at = np.fromiter(map(self.places.get, keys, repeat(-1)), np.int64, len(keys))
        self.again[at[at >= 0]] = True
        return at

    def make_room(self, keys: list[str]) -> bool:
        """Whether known keys had to go for these new ones."""
        length = sum(map(len, keys))
        full = len(self.places) + len(keys) > CACHED_WORDS or self.characters + length > CACHED_CHARACTERS
        if not self.places or not full:
            return False
        old = list(self.places)
        at = np.flatnonzero(self.again[: len(old)])[: CACHED_WORDS // 2]
        lengths = np.fromiter((len(old[i]) for i in at.tolist()), np.int64, len(at))
        at = at[np.cumsum(lengths) <= CACHED_CHARACTERS // 2]
        ids, sizes = self.ids_of(at), self.sizes[at]
        self.__init__()
        self.add([old[i] for i in at.tolist()], ids, sizes)
        return True

    def add(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        at, end = len(self.places), self.used + len(ids)
        self.starts, self.sizes = _room(self.starts, at + len(keys)), _room(self.sizes, at + len(keys))
        self.again, self.ids = _room(self.again, at + len(keys)), _room(self.ids, end)
        self.sizes[at : at + len(keys)] = sizes
        self.starts[at : at + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.again[at : at + len(keys)] = False
        self.ids[self.used : end] = ids
        self.places.update(zip(keys, range(at, at + len(keys))))
        self.used, self.characters = end, self.characters + sum(map(len, keys))

    def ids_of(self, at: np.ndarray) -> np.ndarray:
        """The ids of keys at these places, one after another."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(total)] if total else self.ids[:0]


class WordEncoder:
    """Token ids of whole texts. Known words are looked up, new words are put together from known
    pieces, and only new pieces go to the tokenizer."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The same model for single pieces, which need neither normalizing nor splitting.
        self.model = Tokenizer.from_file(path)
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.words, self.pieces = _Known(), _Known()

    def _look_up(self, known: _Known, keys: list[str], encode) -> np.ndarray:
        """Places of all keys, after learning the new ones."""
        at = known.find(keys)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            lost = [keys[i] for i in missing.tolist()]
            new = list(dict.fromkeys(lost))
            if known.make_room(new):
                # Some of the keys that were known may have gone, and all have new places.
                missing, lost = np.arange(len(keys)), keys
                new = [k for k in dict.fromkeys(keys) if k not in known.places]
            known.add(new, *encode(new))
            at[missing] = known.find(lost)
        return at

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and their number per word."""
        found = [_PIECES.findall(w) for w in words]
        at = self._look_up(self.pieces, list(chain.from_iterable(found)), self._encode_pieces)
        firsts = np.cumsum([0, *map(len, found)])[:-1]
        return self.pieces.ids_of(at), np.add.reduceat(self.pieces.sizes[at], firsts)

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces and their number per piece."""
        found = [e.ids for e in self.model.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.array(list(chain.from_iterable(found)), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text. Texts are looked up together, about GROUP_CHARACTERS at a time."""
        found: list[np.ndarray] = []
        group: list[list[str]] = []
        held = 0
        for text in texts:
            if text and _NOT_PLAIN.search(text):
                found += self._encode_group(group)
                found.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32))
                group, held = [], 0
                continue
            group.append(text.lower().split() if text else [])
            held += len(text or "")
            if held >= GROUP_CHARACTERS:
                found += self._encode_group(group)
                group, held = [], 0
        return found + self._encode_group(group)

    def _encode_group(self, texts: list[list[str]]) -> list[np.ndarray]:
        if not texts:
            return []
        at = self._look_up(self.words, list(chain.from_iterable(texts)), self._encode_words)
        ends = np.cumsum([0, *map(len, texts)])
        cuts = np.concatenate([[0], np.cumsum(self.words.sizes[at])])[ends]
        return np.split(self.words.ids_of(at), cuts[1:-1])


def _room(values: np.ndarray, n: int) -> np.ndarray:
    """The array, or a longer copy with room for at least n values."""
    if n <= len(values):
        return values
    return np.concatenate([values, np.zeros(max(n, 2 * len(values)) - len(values), values.dtype)])


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    """Tasks of one Python worker share the words of their encoder."""
    return WordEncoder(path)


def write_tokens(documents: DataFrame, tokenizer: str, folder: str) -> None:
    """Write the tokens of ``documents`` (doc_id, text) as a token table in ascending doc_id order.

    Every document ends with END_ID, so NULL and empty texts are that id alone. NULL doc_ids come
    first; rows of one doc_id follow each other by text. Other columns are not read.
    """
    prepare(documents.sparkSession)
    docs = documents.select("doc_id", "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // PARTITION_BYTES))
    tie = F.xxhash64("text")
    placed = docs.repartitionByRange(n, "doc_id", tie).sortWithinPartitions("doc_id", tie, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        part = TaskContext.get().partitionId()
        chunk = before = held = 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        end = np.array([END_ID], np.uint32)

        def close() -> pa.RecordBatch:
            sizes = [len(x) for x in ids]
            row = {"part": part, "chunk": chunk, "before": before, "doc_ids": names, "sizes": sizes}
            row["payload"] = token_coder.encode(np.concatenate(ids))
            return pa.RecordBatch.from_pylist([row], schema=_FILE_ARROW)

        for batch in batches:
            encoded = encoder.encode(batch.column(1).to_pylist())
            for doc_id, found in zip(batch.column(0).to_pylist(), encoded):
                ids.append(np.concatenate([found, end]))
                names.append(doc_id)
                held += len(ids[-1])
                if held >= CHUNK_TOKENS:
                    yield close()
                    chunk, before, held, ids, names = chunk + 1, before + held, 0, [], []
        if ids:
            yield close()

    placed.mapInArrow(run, FILE_SCHEMA).write.parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of a token table, from its decoded and checked ids.

    ``start`` counts the ids of all documents before it. The window sees one row per partition of
    the writer.
    """
    prepare(spark)
    files = spark.read.schema(FILE_SCHEMA).parquet(folder)
    per_part = files.select("part", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    per_part = per_part.groupBy("part").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    chunks = files.join(F.broadcast(offsets) if _few(spark, folder) else offsets, "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = token_coder.decode(row["payload"])
                sizes = np.array(row["sizes"], np.int64)
                ends = np.cumsum(sizes)
                starts = ends - sizes
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(starts + row["before"] + row["offset"]),
                        pa.array(sizes),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    wanted = chunks.select("before", "offset", "doc_ids", "sizes", "payload")
    return wanted.mapInArrow(run, SCHEMA)


def _few(spark: SparkSession, folder: str, most: int = 100_000) -> bool:
    """Whether the table has few writer partitions (a dozen bytes each)."""
    return spark.read.schema(FILE_SCHEMA).parquet(folder).select("part").distinct().limit(most + 1).count() <= most


def token_rows(documents: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``documents`` to a token table in the shared folder and read it back."""
    folder = new_folder(documents.sparkSession, "token-ids")
    write_tokens(documents, tokenizer, folder)
    return read_tokens(documents.sparkSession, folder)
