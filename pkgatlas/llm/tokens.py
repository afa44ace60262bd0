"""Token ids of texts by a public tokenizer, distinct pieces of many texts at a time.

Encoding a whole text at once costs mostly bookkeeping. The tokenizers here cut a text before
any merge, and never join over certain white space; so texts are cut there, all at once by
arrays, every distinct piece is encoded once by the tokenizers library, and the ids are put
back in order. Texts that hold other white space where that cut would not be safe are encoded
whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Cached pieces of one generation; a full one becomes the older one, so memory is bounded.
CACHE_PIECES = 600_000
#: A longer piece is encoded but not kept.
LONGEST_KEPT = 64
#: Bytes of text that are cut at a time; a longer text is taken alone.
CHUNK_BYTES = 8 << 20

#: Bytes as the letters that byte-level vocabularies use: printable ones as they are, the
#: others from 256 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_SPACE = chr(_LETTERS[0x20])
#: Letters of one or two bytes that every version of Unicode has as letters.
_WORD = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")

_BYTE = np.arange(256)
_BLANK = (_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13))
_BREAK = (_BYTE == 32) | (_BYTE == 10)
_LETTER_OR_DIGIT = np.array([chr(c).isascii() and chr(c).isalnum() for c in range(256)])
_CONTROL = ((_BYTE < 32) & (_BYTE != 10)) | (_BYTE == 127)
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: First bytes of the other characters that one of the libraries may take for white space.
_WIDE = np.isin(_BYTE, [0xC2, 0xE1, 0xE2, 0xE3, 0xEF])
_WIDE_BLANK = re.compile(
    rb"\xc2[\x80-\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2[\x80\x81]|\xe3\x80\x80|\xef\xbb\xbf"
)


class Texts:
    """Texts as one array of bytes; text i is data[at[i]:at[i + 1]]."""

    def __init__(self, data: np.ndarray, at: np.ndarray) -> None:
        self.data, self.at = data, at
        self.full = at[:-1] < at[1:]

    def holding(self, places: np.ndarray) -> np.ndarray:
        """Which texts hold one of the places."""
        out = np.zeros(len(self.at) - 1, bool)
        out[np.searchsorted(self.at, places, "right") - 1] = True
        return out

    def marks(self) -> np.ndarray:
        """Full stops and commas alone at a word's end: a piece of their own in these tokenizers."""
        data = self.data
        found = np.flatnonzero((data == 46) | (data == 44))
        found = found[found > 0]
        before = data[found - 1]
        # the second byte of a letter from U+00C0 to U+00FF
        latin = (data[found - 2] == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
        found = found[_LETTER_OR_DIGIT[before] | latin]
        after = np.append(data, np.uint8(32))[found + 1]
        ends = np.zeros(len(data) + 1, bool)
        ends[self.at] = True
        return found[(_BREAK[after] | ends[found + 1]) & ~ends[found]]


def _split(values: pa.LargeBinaryArray) -> list[bytes]:
    """The values of an array without offset, faster than one by one."""
    _, ends, data = values.buffers()
    ends = np.frombuffer(ends, np.int64)[: len(values) + 1].tolist()
    raw = data.to_pybytes() if data else b""
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


class PieceEncoder:
    """ids of texts as little-endian unsigned 32-bit numbers, ``end_id`` after each.

    ``cut`` gives, for some texts, which of them cannot be cut, their bytes without those between
    pieces, and where each piece begins in these; ``piece_text`` is a piece as text, ``plain`` its
    letters when it can go straight to the merges.
    """

    def __init__(self, path: str, cut: Callable[[Texts], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]],
                 piece_text: Callable[[bytes], str], plain: Callable[[bytes], str | None], end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cut, self.piece_text, self.plain = cut, piece_text, plain
        self.end = end_id
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        # special tokens are matched before any cut, so texts that hold one are encoded whole
        self.special = [
            re.compile(re.escape(t.content.encode())) for t in self.tokenizer.get_added_tokens_decoder().values()
        ]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [
            np.array(e.ids, "<u4").tobytes()
            for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ]

    def _missing(self, pieces: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Plain words go straight to the merges; other pieces through the whole tokenizer."""
        rest, merge = [], self.tokenizer.model.tokenize
        for p in pieces:
            word = self.plain(p)
            if word is None:
                rest.append(p)
            else:
                yield p, array("I", [t.id for t in merge(word)]).tobytes()
        yield from zip(rest, self._encode([self.piece_text(p) for p in rest]))

    def _ids_of(self, pieces: list[bytes]) -> list[bytes]:
        """ids of distinct pieces, through the cache."""
        found = list(map(self.cache.get, pieces))
        gone = [k for k, ids in enumerate(found) if ids is None]
        if gone:
            new = {pieces[k]: self.older.get(pieces[k]) for k in gone}
            new.update(self._missing([p for p, ids in new.items() if ids is None]))
            for k in gone:
                found[k] = new[pieces[k]]
            kept = {p: ids for p, ids in new.items() if len(p) <= LONGEST_KEPT}
            if len(self.cache) + len(kept) > CACHE_PIECES:
                self.older, self.cache = self.cache, {}
            if len(kept) <= CACHE_PIECES:
                self.cache.update(kept)
        return found

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of text i, which is data[at[i]:at[i + 1]], end at ends[i]."""
        texts = Texts(data, at)
        whole, held, of_text, begin = self.cut(texts)
        raw = data.tobytes()
        for special in self.special:
            if places := [m.start() for m in special.finditer(raw)]:
                whole |= texts.holding(np.array(places))
        if whole.any():
            cut_too = ~whole[of_text]
            sizes = np.diff(np.append(begin, len(held)))
            held, sizes, of_text = held[np.repeat(cut_too, sizes)], sizes[cut_too], of_text[cut_too]
            begin = np.cumsum(sizes) - sizes
        pieces = pa.Array.from_buffers(
            pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(held)).astype(np.int64)), pa.py_buffer(held)]
        ).dictionary_encode()
        known = self._ids_of(_split(pieces.dictionary))
        flat = np.frombuffer(b"".join(known), "<u4")
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts = np.cumsum(sizes) - sizes
        codes = pieces.indices.to_numpy()
        n = sizes[codes]
        lengths = np.ones(len(at) - 1, np.int64)
        lengths += np.bincount(of_text, weights=n, minlength=len(lengths)).astype(np.int64)
        alone = dict(zip(
            np.flatnonzero(whole).tolist(),
            self._encode([raw[at[i] : at[i + 1]].decode() for i in np.flatnonzero(whole).tolist()]),
        ))
        for i, ids in alone.items():
            lengths[i] += len(ids) // 4
        ends = np.cumsum(lengths)
        out = np.empty(int(lengths.sum()), "<u4")
        cut_ids = np.ones(len(out), bool)
        cut_ids[ends - 1] = False
        out[ends - 1] = self.end
        for i, ids in alone.items():
            some = slice(ends[i] - lengths[i], ends[i] - 1)
            out[some], cut_ids[some] = np.frombuffer(ids, "<u4"), False
        source = np.repeat(starts[codes] - (np.cumsum(n) - n), n)
        source += np.arange(len(source))
        out[cut_ids] = flat[source]
        return out, ends

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each of the ``texts`` (binary), a chunk of texts at a time."""
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        values = texts.buffers()[2]
        data = np.frombuffer(values, np.uint8) if values else np.empty(0, np.uint8)
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(at, at[first] + CHUNK_BYTES, "right")) - 1)
            part = at[first : last + 1]
            ids, ends = self.encode(data[part[0] : part[-1]], part - part[0])
            start = 0
            for end in ends.tolist():
                yield ids[start:end]
                start = end
            first = last


def _mapped(word: bytes) -> str:
    """Bytes as the vocabulary's letters."""
    return word.decode("latin-1").translate(_LETTERS)


def _cut_at_white(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, at = texts.data, texts.at
    lowered = _LOWER[data]
    accents = np.flatnonzero((data == 0xCC) | (data == 0xCD))
    if len(accents):  # they combine with the letter before, so such texts are lower-cased by the tokenizer
        keep = np.repeat(texts.holding(accents), np.diff(at))
        lowered[keep] = data[keep]
    blank = _BLANK[data]
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    first = first[:-1]
    first[1:] |= blank[:-1]
    first[texts.marks()] = True
    first &= ~blank
    begin = np.flatnonzero(first)
    of_text = np.searchsorted(at, begin, "right") - 1
    return np.zeros(len(at) - 1, bool), lowered[~blank], of_text, (np.cumsum(~blank) - 1)[begin]


def _plain_lower(piece: bytes) -> str | None:
    if piece.isalpha():
        return piece.decode() if piece.islower() else None
    word = piece.decode()
    return _mapped(piece) if _WORD.fullmatch(word) and word.islower() else None


@cache
def word_encoder(path: str, end_id: int) -> PieceEncoder:
    """For a lower-casing tokenizer that drops white space before its merges."""
    return PieceEncoder(path, _cut_at_white, bytes.decode, _plain_lower, end_id)


def _cut_before_space(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, at = texts.data, texts.at
    breaks = _BREAK[data]
    odd = _CONTROL[data]
    odd[1:] |= breaks[1:] & breaks[:-1]
    odd[at[:-1][texts.full]] |= breaks[at[:-1][texts.full]]
    odd[at[1:][texts.full] - 1] |= breaks[at[1:][texts.full] - 1]
    wide = np.flatnonzero(_WIDE[data])
    if len(wide):
        raw = np.append(data, np.zeros(2, np.uint8))
        three = raw[wide[:, None] + np.arange(3)]
        odd[wide[[_WIDE_BLANK.match(c.tobytes()) is not None for c in three]]] = True
    whole = texts.holding(np.flatnonzero(odd))
    first = data == 32
    line = np.flatnonzero(data == 10)
    first[line] = True
    first[line[line + 1 < len(data)] + 1] = True
    first[at[:-1][texts.full]] = True
    first[texts.marks()] = True
    begin = np.flatnonzero(first)
    return whole, data, np.searchsorted(at, begin, "right") - 1, begin


def _plain_spaced(piece: bytes) -> str | None:
    word = piece[1:] if piece[:1] == b" " else piece
    if word.isalpha():  # of bytes: A-Z and a-z only
        return _SPACE + word.decode() if word is not piece else word.decode()
    if not _WORD.fullmatch(word.decode()):
        return None
    return _mapped(piece)


@cache
def byte_level_encoder(path: str, end_id: int) -> PieceEncoder:
    """For a byte-level tokenizer that keeps one space with the word after it.

    A single space or line feed between other characters begins a new piece; a text with any
    other white space, or two in a row, is encoded whole.
    """
    return PieceEncoder(path, _cut_before_space, bytes.decode, _plain_spaced, end_id)
