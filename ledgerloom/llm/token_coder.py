"""Adaptive context-mixing range coder for token ids.

A chunk of ids is cut into blocks that are coded independently: contexts and weights start afresh
in every block and each block carries its own checksum. All blocks of a chunk advance in step, one
id per step, so a step is a fixed number of numpy operations over all blocks.

Three models predict the next id of a block. Order 2 and order 1 each remember the id that last
followed their context in the block, with a confidence that grows with hits. Order 0 starts every
block from the frequencies of the whole chunk, which the chunk's header holds; a block is too
short to learn them by itself. The confidences select a set of adaptive weights that mix the
three: the range is divided between "order 2 is right", "order 1 is right" and "order 0 decides",
and the last part is divided again by the frequencies of order 0.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"TIDC2\0"
_HEAD = "<QIIIII"  # ids, ids of a block, blocks, alphabet, bits of a frequency, bytes of the alphabet
_CTX = 11  # bits of the context tables
_LEVELS = 4  # confidences 0 .. 3
_MIX_BITS = 12
_RATE = 4  # a weight moves by 1/16 of its error
_LOW = np.uint64((1 << 32) - 1)
_U16, _U32 = np.uint64(16), np.uint64(32)
_LEAST_BLOCK, _MOST_BLOCK, _LANES = 256, 4096, 2048
_ALPHABET = 1 << 16  # different ids of a segment; frequencies have 16 or 18 bits
_DENSE = 1 << 20  # ids below it are numbered by a table
# Next confidence after (confidence, hit).
_TRUST = np.array([(c >> 1, min(c + 1, _LEVELS - 1)) for c in range(_LEVELS)], np.int32).reshape(-1)
# Where the border of a part moves when the id lies behind it (0) or before (1).
_FIRST = np.array([16, (1 << _MIX_BITS) - 48], np.int32)
_SECOND = np.array([32, (1 << _MIX_BITS) - 16], np.int32)
# Multipliers that spread contexts over a table: of the last id for order 1, of the last two for order 2.
_SPREAD1, _SPREAD2, _SPREAD3 = np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917)
_KEEP = np.uint32(32 - _CTX)


def _contexts(last: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table places of the order 1 and order 2 contexts."""
    one, two = last * _SPREAD1, last * _SPREAD2
    two += earlier * _SPREAD3
    one >>= _KEEP
    two >>= _KEEP
    return one, two


class _Mixer:
    """Predictions and weights of ``k`` blocks."""

    def __init__(self, k: int) -> None:
        rows = np.arange(k)
        self.table_at = rows << _CTX
        # A guessed id and its confidence share one number: id * 4 + confidence.
        self.table2, self.table1 = np.zeros(k << _CTX, np.int32), np.zeros(k << _CTX, np.int32)
        # The mixed range per block and pair of confidences: borders of the first two parts.
        self.mix_at = rows * (_LEVELS * _LEVELS)
        self.first = np.full(k * _LEVELS * _LEVELS, (1 << _MIX_BITS) // 16, np.int32)
        self.second = np.full(k * _LEVELS * _LEVELS, (1 << _MIX_BITS) // 8, np.int32)

    def predict(self, k: int, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Guesses of order 2 and 1 and the borders of the first two parts, of the first k blocks."""
        self.slot1, self.slot2 = self.table_at[:k] + one, self.table_at[:k] + two
        entry2, entry1 = self.table2.take(self.slot2), self.table1.take(self.slot1)
        self.trust2, self.trust1 = entry2 & 3, entry1 & 3
        self.mix = self.mix_at[:k] + (self.trust2 * _LEVELS + self.trust1)
        self.border1 = self.first.take(self.mix)
        self.border2 = np.maximum(self.second.take(self.mix), self.border1 + 1)
        return entry2 >> 2, entry1 >> 2, self.border1, self.border2

    def update(self, ids: np.ndarray, right2: np.ndarray, right1: np.ndarray) -> None:
        """Learn the ids; ``right`` says whether the guess of an order was right."""
        entry = ids << 2
        hit2 = right2.view(np.int8)
        self.table2[self.slot2] = entry | _TRUST.take(self.trust2 * 2 + hit2)
        self.table1[self.slot1] = entry | _TRUST.take(self.trust1 * 2 + right1.view(np.int8))
        self.first[self.mix] = self.border1 + (_FIRST.take(hit2) - self.border1 >> _RATE)
        self.second[self.mix] = self.border2 + (_SECOND.take((right2 | right1).view(np.int8)) - self.border2 >> _RATE)


def _part(
    right2: np.ndarray, right1: np.ndarray, first: np.ndarray, second: np.ndarray, below: np.ndarray, freq: np.ndarray, bits: int
) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of the part of the range that holds the id, of 2 ** (_MIX_BITS + bits)."""
    rest = (1 << _MIX_BITS) - second
    start = np.where(right2, 0, np.where(right1, first << bits, (second << bits) + rest * below))
    size = np.where(right2, first << bits, np.where(right1, second - first << bits, rest * freq))
    return start.astype(np.uint64), size.astype(np.uint64)


class _Writer:
    """Range encoders of ``k`` blocks; carries wait in the words until the end."""

    def __init__(self, k: int, steps: int) -> None:
        self.low, self.range = np.zeros(k, np.uint64), np.full(k, 1 << 48, np.uint64)
        self.width = 2 * steps + 4
        self.words = np.zeros(k * self.width, np.uint32)
        self.used = np.arange(k) * self.width

    def put(self, k: int, start: np.ndarray, size: np.ndarray, bits: int) -> None:
        low, width = self.low[:k], self.range[:k]
        unit = width >> np.uint64(bits)
        low += unit * start
        np.multiply(unit, size, out=width)
        short = np.flatnonzero(width <= _LOW)
        while len(short):  # at most twice
            at, value = self.used[short], low[short]
            self.words[at] = value >> _U32
            self.used[short] = at + 1
            low[short] = (value & _LOW) << _U16
            grown = width[short] << _U16
            width[short] = grown
            short = short[grown <= _LOW]

    def finish(self) -> list[bytes]:
        for _ in range(3):
            self.words[self.used] = self.low >> _U32
            self.used += 1
            self.low = (self.low & _LOW) << _U16
        n = self.used - np.arange(len(self.used)) * self.width
        words = self.words.reshape(-1, self.width)[:, : n.max()]
        out = np.empty(words.shape, "<u2")
        carry = np.zeros(len(words), np.uint32)
        for i in range(words.shape[1] - 1, -1, -1):
            column = words[:, i] + carry
            carry = column >> np.uint32(16)
            out[:, i] = column & np.uint32(0xFFFF)
        return [out[i, :m].tobytes() for i, m in enumerate(n.tolist())]


class _Reader:
    def __init__(self, parts: list[bytes]) -> None:
        longest = max(len(p) for p in parts) // 2 + 4
        words = np.zeros((len(parts), longest), np.uint16)
        for i, p in enumerate(parts):
            words[i, : len(p) // 2] = np.frombuffer(p, "<u2")
        first = words[:, :3].astype(np.uint64)
        self.code = first[:, 0] << _U32 | first[:, 1] << _U16 | first[:, 2]
        self.range = np.full(len(parts), 1 << 48, np.uint64)
        self.words = words.reshape(-1)
        self.used = np.arange(len(parts)) * longest + 3

    def peek(self, k: int, bits: int) -> np.ndarray:
        self.unit = self.range[:k] >> np.uint64(bits)
        return np.minimum(self.code[:k] // self.unit, np.uint64((1 << bits) - 1)).astype(np.int32)

    def take(self, k: int, start: np.ndarray, size: np.ndarray) -> None:
        code, width = self.code[:k], self.range[:k]
        code -= self.unit * start
        np.multiply(self.unit, size, out=width)
        short = np.flatnonzero(width <= _LOW)
        while len(short):
            at = self.used[short]
            # A damaged block may ask for more words than there are; its checksum will not hold.
            code[short] = code[short] << _U16 | self.words.take(at, mode="clip")
            self.used[short] = at + 1
            grown = width[short] << _U16
            width[short] = grown
            short = short[grown <= _LOW]


def _numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids in order, and each id's place among them."""
    if not len(ids) or ids.max() >= _DENSE:
        return np.unique(ids, return_inverse=True)
    held = np.zeros(int(ids.max()) + 1, bool)
    held[ids] = True
    return np.flatnonzero(held), (np.cumsum(held, dtype=np.int32) - 1)[ids]


def _frequencies(coded: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """Frequencies of order 0 that add up to 2 ** bits, at least one per id, and bits."""
    bits = 16 if n <= 1 << 13 else 18
    counts = np.bincount(coded, minlength=n)
    freq = 1 + counts * ((1 << bits) - n) // len(coded)
    freq[counts.argmax()] += (1 << bits) - freq.sum()
    return freq.astype(np.int32), bits


def _below(freq: np.ndarray) -> np.ndarray:
    return (np.cumsum(freq) - freq).astype(np.int32)


def _encode_blocks(columns: np.ndarray, freq: np.ndarray, bits: int, tail: int) -> list[bytes]:
    """Code blocks given by step and block; the last one ends after ``tail`` steps."""
    size, k = columns.shape
    mixer, out, below = _Mixer(k), _Writer(k, size), _below(freq)
    last = earlier = np.zeros(k, np.uint32)
    for t in range(size):
        m = k if t < tail else k - 1
        if not m:
            break
        now = columns[t, :m]
        guess2, guess1, first, second = mixer.predict(m, *_contexts(last[:m], earlier[:m]))
        right2, right1 = guess2 == now, guess1 == now
        out.put(m, *_part(right2, right1, first, second, below.take(now), freq.take(now), bits), _MIX_BITS + bits)
        mixer.update(now, right2, right1)
        last, earlier = now.view(np.uint32), last
    return out.finish()


def _decode_blocks(parts: list[bytes], freq: np.ndarray, bits: int, size: int, tail: int) -> np.ndarray:
    """Inverse of ``_encode_blocks``: one row per block."""
    k = len(parts)
    source, mixer, below = _Reader(parts), _Mixer(k), _below(freq)
    holder = np.repeat(np.arange(len(freq), dtype=np.int32), freq)  # the id at each place of order 0
    columns = np.zeros((size, k), np.int32)
    last = earlier = np.zeros(k, np.uint32)
    for t in range(size):
        m = k if t < tail else k - 1
        if not m:
            break
        guess2, guess1, first, second = mixer.predict(m, *_contexts(last[:m], earlier[:m]))
        value = source.peek(m, _MIX_BITS + bits)
        mixed = value >> bits
        in_first, in_second = mixed < first, mixed < second
        place = (value - (second << bits)) // ((1 << _MIX_BITS) - second)
        now = np.where(in_first, guess2, np.where(in_second, guess1, holder.take(place, mode="clip")))
        source.take(m, *_part(in_first, in_second, first, second, below.take(now), freq.take(now), bits))
        # Where two models name the id, the encoder counts both as right.
        mixer.update(now, guess2 == now, guess1 == now)
        columns[t, :m] = now
        last, earlier = now.view(np.uint32), last
    return columns.T


def _encode_segment(ids: np.ndarray, alphabet: np.ndarray, coded: np.ndarray) -> bytes:
    size = min(_MOST_BLOCK, max(_LEAST_BLOCK, -(-len(ids) // _LANES)))
    k, n = -(-len(ids) // size), len(alphabet)
    freq, bits = _frequencies(coded, n)
    # Steps between the sorted ids, and frequencies; both are mostly small.
    listed = zlib.compress(np.concatenate([np.diff(alphabet, prepend=0), freq]).astype("<u4").tobytes())
    grid = np.zeros((k, size), np.int32)
    grid.reshape(-1)[: len(ids)] = coded
    tail = len(ids) - (k - 1) * size  # only the last block may be shorter
    blocks = _encode_blocks(np.ascontiguousarray(grid.T), freq, bits, tail)
    sums = [zlib.crc32(ids[i * size : (i + 1) * size].tobytes()) for i in range(k)]
    head = struct.pack(_HEAD, len(ids), size, k, n, bits, len(listed)) + listed
    return head + b"".join(struct.pack("<II", c, len(b)) for c, b in zip(sums, blocks)) + b"".join(blocks)


def encode(ids: np.ndarray) -> bytes:
    """A self-describing chunk of uint32 ids: one segment, or several if there are very many different ids."""
    ids = np.ascontiguousarray(ids, "<u4")
    if not len(ids):
        return MAGIC
    alphabet, coded = _numbered(ids)
    if len(alphabet) <= _ALPHABET:
        return MAGIC + _encode_segment(ids, alphabet, coded)
    cuts = (ids[i : i + _ALPHABET] for i in range(0, len(ids), _ALPHABET))
    return MAGIC + b"".join(_encode_segment(x, *_numbered(x)) for x in cuts)


def _decode_segment(data: bytes, at: int) -> tuple[np.ndarray, int]:
    """The ids of the segment that starts at a place, and the place behind it."""
    total, size, k, n, bits, listed = struct.unpack_from(_HEAD, data, at)
    at += struct.calcsize(_HEAD)
    both = np.frombuffer(zlib.decompress(data[at : at + listed]), "<u4")
    alphabet, freq = np.cumsum(both[:n], dtype=np.uint32), both[n:].astype(np.int32)
    at += listed
    heads = np.frombuffer(data, "<u4", 2 * k, at).reshape(k, 2)
    at += 8 * k
    parts = []
    for length in heads[:, 1].tolist():
        parts.append(data[at : at + length])
        at += length
    grid = _decode_blocks(parts, freq, bits, size, total - (k - 1) * size)
    ids = alphabet[grid.reshape(-1)[:total]]
    for i, checksum in enumerate(heads[:, 0].tolist()):
        if zlib.crc32(ids[i * size : (i + 1) * size].astype("<u4").tobytes()) != checksum:
            raise ValueError(f"checksum of block {i} does not hold")
    return ids, at


def decode(data: bytes) -> np.ndarray:
    """The ids of a chunk; ValueError if the magic or a block's checksum does not hold."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token-id chunk")
    at, found = len(MAGIC), [np.empty(0, np.uint32)]
    while at < len(data):
        ids, at = _decode_segment(data, at)
        found.append(ids)
    return np.concatenate(found)
