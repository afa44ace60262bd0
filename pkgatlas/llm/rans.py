"""Static range asymmetric numeral system for token ids: an encoder and decoder of segments.

A segment holds whole documents. Its ids are coded with one frequency table in independent
blocks; inside a block, ``LANES`` interleaved coders each take every LANES-th id, so numpy
codes LANES ids at a time. Layout, little endian:

    magic "RANS1\\0"            6 bytes
    table bits                 u16      frequencies sum to 2 ** bits
    symbols, blocks, ids       u32, u32, u64
    table                      symbols x u32 id, then symbols x u32 frequency (zlib, u32 length first)
    checkpoints                blocks x (u64 first byte, u64 first id, u32 ids, u32 crc32 of its ids)
    blocks                     LANES x u64 states, then u32 words

A checkpoint and the table are all that is needed to decode its block alone; byte places count from
the first block. ``Segment.cut`` makes a segment of its own from some blocks without decoding any.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable
from functools import cached_property

import numpy as np

MAGIC = b"RANS1\x00"
LANES = 2048
BLOCK_IDS = 1 << 19
_HEAD = struct.Struct("<6sHIIQ")
_POINT = np.dtype([("byte", "<u8"), ("first", "<u8"), ("ids", "<u4"), ("crc", "<u4")])
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)


def table_bits(n_symbols: int) -> int:
    """Enough for every symbol to have a frequency of one and common ones to stand out."""
    return min(24, max(12, int(max(n_symbols, 1) - 1).bit_length() + 3))


def frequencies(counts: np.ndarray, bits: int) -> np.ndarray:
    """Whole frequencies near the counts' shares, at least 1 each, that sum to 2 ** bits."""
    total = 1 << bits
    spare = total - len(counts)
    out = 1 + (counts * spare // counts.sum()).astype(np.int64)
    out[np.argmax(counts)] += total - out.sum()
    return out


def _encode_block(symbols: np.ndarray, freq: np.ndarray, start: np.ndarray, bits: int) -> bytes:
    state = np.full(LANES, _LOW, np.uint64)
    words: list[np.ndarray] = []
    full = len(symbols) // LANES * LANES
    steps = [symbols[full:]] if full < len(symbols) else []
    steps += [symbols[at : at + LANES] for at in range(full - LANES, -1, -LANES)]
    up, limit = np.uint64(bits), np.uint64(63 - bits)
    for part in steps:
        f, s = freq[part], start[part]
        x = state[: len(part)]
        over = x >= f << limit
        if over.any():
            words.append(x[over].astype(np.uint32))
            x = np.where(over, x >> _WORD, x)
        high = x // f
        state[: len(part)] = (high << up) + (x - high * f) + s
    # the decoder reads the other way round
    stream = np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)
    return state.astype("<u8").tobytes() + stream.astype("<u4").tobytes()


def _decode_block(data: bytes, n: int, freq: np.ndarray, start: np.ndarray, slots: np.ndarray, bits: int) -> np.ndarray:
    state = np.frombuffer(data, "<u8", LANES).copy()
    words = np.frombuffer(data, "<u4", offset=8 * LANES)
    out = np.empty(n, np.int64)
    mask, up, at = np.uint64((1 << bits) - 1), np.uint64(bits), 0
    for begin in range(0, n, LANES):
        size = min(LANES, n - begin)
        x = state[:size]
        low = x & mask
        part = slots[low.astype(np.int64)]
        out[begin : begin + size] = part
        x = freq[part] * (x >> up) + low - start[part]
        need = np.flatnonzero(x < _LOW)
        if len(need):
            x[need] = (x[need] << _WORD) | words[at : at + len(need)]
            at += len(need)
        state[:size] = x
    if at != len(words) or not (state == _LOW).all():
        raise ValueError("block is damaged: its coders do not end where they began")
    return out


def _ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids, each id's rank among them, and their counts."""
    if not len(ids) or ids.max() >= 1 << 22:
        return np.unique(ids, return_inverse=True, return_counts=True)
    counts = np.bincount(ids)  # a vocabulary: no sort is needed
    symbols = np.flatnonzero(counts)
    rank = np.zeros(len(counts), np.int32)
    rank[symbols] = np.arange(len(symbols))
    return symbols, rank[ids], counts[symbols]


def block_ends(lengths: Iterable[int], block_ids: int = BLOCK_IDS) -> list[int]:
    """Ends of blocks that hold whole documents; a document above ``block_ids`` has blocks of its own."""
    ends: list[int] = []
    at = begun = 0
    for n in lengths:
        if n > block_ids:
            ends += [at] * (at > begun) + list(range(at + block_ids, at + n, block_ids)) + [at + n]
            begun = at + n
        elif at + n - begun >= block_ids:
            ends.append(at + n)
            begun = at + n
        at += n
    return ends + [at] * (at > begun)


def encode(ids: np.ndarray, ends: list[int] | None = None) -> bytes:
    """A segment of unsigned 32-bit ids; its blocks close at ``ends``, else after ``BLOCK_IDS`` ids each."""
    if ends is None:
        ends = [*range(BLOCK_IDS, len(ids), BLOCK_IDS), len(ids)] if len(ids) else []
    symbols, place, counts = _ranked(ids)
    bits = table_bits(len(symbols))
    freq = frequencies(counts, bits) if len(symbols) else np.empty(0, np.int64)
    start = np.cumsum(freq) - freq
    f, s = freq.astype(np.uint64), start.astype(np.uint64)
    blocks, points, at = [], np.zeros(len(ends), _POINT), 0
    for n, (first, end) in enumerate(zip([0, *ends], ends)):
        some = ids[first:end].astype("<u4")
        block = _encode_block(place[first:end], f, s, bits)
        points[n] = (at, first, len(some), zlib.crc32(some.tobytes()))
        blocks.append(block)
        at += len(block)
    table = zlib.compress(symbols.astype("<u4").tobytes() + freq.astype("<u4").tobytes())
    return b"".join([
        _HEAD.pack(MAGIC, bits, len(symbols), len(points), len(ids)),
        struct.pack("<I", len(table)), table, points.tobytes(), *blocks,
    ])


class Segment:
    """A coded segment; blocks decode in any order."""

    def __init__(self, data: bytes) -> None:
        magic, self.bits, self.n_symbols, n_blocks, self.n_ids = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a segment of coded ids")
        at = _HEAD.size
        (length,) = struct.unpack_from("<I", data, at)
        self.packed = data[at + 4 : at + 4 + length]
        at += 4 + length
        self.points = np.frombuffer(data, _POINT, n_blocks, at)
        self.body = data[at + n_blocks * _POINT.itemsize :]

    @cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, frequencies, running frequencies and the rank behind each slot."""
        table = np.frombuffer(zlib.decompress(self.packed), "<u4")
        freq = table[self.n_symbols :].astype(np.int64)
        slots = np.repeat(np.arange(self.n_symbols), freq)
        return table[: self.n_symbols], freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64), slots

    def _byte_end(self, n: int) -> int:
        return int(self.points[n]["byte"]) if n < len(self.points) else len(self.body)

    def cut(self, begin: int, end: int) -> bytes:
        """Blocks ``begin`` to ``end`` (exclusive) as a segment with the same table."""
        points = self.points[begin:end].copy()
        at = self._byte_end(begin)
        points["byte"] -= np.uint64(at)
        points["first"] -= self.points[begin]["first"]
        return b"".join([
            _HEAD.pack(MAGIC, self.bits, self.n_symbols, len(points), int(points["ids"].sum())),
            struct.pack("<I", len(self.packed)), self.packed, points.tobytes(), self.body[at : self._byte_end(end)],
        ])

    def block(self, n: int) -> np.ndarray:
        """The ids of block ``n``, checked against its checksum."""
        point = self.points[n]
        symbols, freq, start, slots = self.tables
        place = _decode_block(
            self.body[int(point["byte"]) : self._byte_end(n + 1)], int(point["ids"]), freq, start, slots, self.bits
        )
        ids = symbols[place]
        if zlib.crc32(ids.tobytes()) != point["crc"]:
            raise ValueError(f"checksum of block {n} differs")
        return ids

    def ids(self) -> np.ndarray:
        parts = [self.block(n) for n in range(len(self.points))]
        return np.concatenate(parts) if parts else np.empty(0, "<u4")
