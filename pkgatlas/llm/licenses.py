"""License scans: exact phrases, and short notices found with a bounded number of edits.

A notice that occurs with at most e edits contains one of e + 1 disjoint pieces of itself
unchanged. All pieces of all notices are searched exactly in one pass; only around such a seed
does the regex library match the whole notice with bounded errors.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Mapping

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgatlas.llm.common import text_or_empty

# Phrases of the base scan and their labels.
PHRASES: Mapping[str, str] = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Short notices of public licenses, as words; each becomes a label of its own.
NOTICES: Mapping[str, str] = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-sa": "licensed under a creative commons attribution sharealike",
    "cc-by": "licensed under cc by",
    "cc0": "to the extent possible under law the author has waived all copyright",
    "gpl": "licensed under the gnu general public license",
    "lgpl": "gnu lesser general public license",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license",
    "reserved": "all rights reserved",
}
#: One edit for so many characters of a notice.
CHARS_PER_EDIT = 12
MAX_EDITS = 4

#: Bytes outside letters, digits and non-ASCII become spaces; A-Z become a-z.
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def pieces_of(notice: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` pieces of nearly equal length that cover the notice, with their starts."""
    n, k = len(notice), edits + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class NoticeFinder:
    """Finds notices with bounded edits in a normalised line of words."""

    def __init__(self, notices: Mapping[str, str], chars_per_edit: int, max_edits: int) -> None:
        self.notices = []
        self.seeds = ahocorasick.Automaton()
        at_seed: dict[str, list[tuple[int, int]]] = {}
        for label, notice in sorted(notices.items()):
            edits = min(max_edits, len(notice) // chars_per_edit)
            # with the spaces around it, which cost no edit; the library allows no insertion where a
            # search begins. The fewest edits are told.
            pattern = regex.compile(rf"(?b)(?: {regex.escape(notice, literal_spaces=True)} ){{e<={edits}}}")
            for start, piece in pieces_of(notice, edits):
                at_seed.setdefault(piece, []).append((len(self.notices), start))
            self.notices.append((label, notice, edits, pattern))
        for piece, uses in at_seed.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()

    def find(self, line: str) -> list[tuple[str, int, int, int]]:
        """(label, start, end, edits), by start.

        Every span of whole words around a seed is verified by itself. Of spans of one label that
        overlap, the one with fewest edits is told, then the first, then the shorter.
        """
        padded = f" {line} "
        tried: dict[tuple[int, int, int], int | None] = {}
        for last, (size, uses) in self.seeds.iter(line):
            first = last - size + 1
            for n, start in uses:
                _, notice, edits, pattern = self.notices[n]
                # a match with this piece at its place begins and ends within the edits
                begin, end = first - start, first - start + len(notice)
                for low in _spaces(padded, begin - edits, begin + edits):
                    for high in _spaces(padded, end - edits + 1, end + edits + 1):
                        span = high - low - 1
                        if abs(span - len(notice)) > edits or (n, low, high) in tried:
                            continue
                        m = pattern.fullmatch(padded, low, high + 1)
                        tried[n, low, high] = sum(m.fuzzy_counts) if m else None
        found: list[tuple[str, int, int, int]] = []
        taken: dict[int, list[tuple[int, int]]] = {}
        matches = [(cost, n, low, high - 1) for (n, low, high), cost in tried.items() if cost is not None]
        for cost, n, low, high in sorted(matches):
            own = taken.setdefault(n, [])
            at = bisect_left(own, (low, high))
            if (at == 0 or own[at - 1][1] <= low) and (at == len(own) or high <= own[at][0]):
                own.insert(at, (low, high))
                found.append((self.notices[n][0], low, high, cost))
        return sorted(found, key=lambda x: (x[1], x[0]))


def _spaces(padded: str, low: int, high: int) -> Iterator[int]:
    """Places of the spaces from ``low`` to ``high``."""
    at = padded.find(" ", max(0, low), high + 1)
    while at >= 0:
        yield at
        at = padded.find(" ", at + 1, high + 1)


def notices_from(table: DataFrame, label_col: str = "label", text_col: str = "text", at_most: int = 100_000) -> dict[str, str]:
    """Notices of a table, normalised; a table above ``at_most`` rows, or a label with two notices, is refused."""
    rows = table.select(label_col, text_col).na.drop().distinct().limit(at_most + 1).collect()
    out = {label: b" ".join(normal_words(text.encode())).decode() for label, text in rows}
    if len(rows) > at_most or len(out) < len(rows):
        raise ValueError("too many notices, or two of one label")
    return {label: notice for label, notice in out.items() if notice}


def _phrase_places(line: bytes, phrase: bytes) -> list[int]:
    """Numbers of the words at which the phrase stands, every place."""
    places, at, word, seen = [], line.find(phrase), 0, 0
    while at >= 0:
        word += line.count(b" ", seen, at)
        seen = at
        places.append(word)
        at = line.find(phrase, at + 1)
    return places


def _scan_task(phrases: Mapping[str, str], notices: Mapping[str, str], chars_per_edit: int, max_edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = NoticeFinder(notices, chars_per_edit, max_edits)
        wanted = [(f" {phrase} ".encode(), label) for phrase, label in phrases.items()]
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = normal_words(text.as_py())
                line = b" " + b" ".join(words) + b" "
                base: list[int] = []
                labels = set()
                for phrase, label in wanted:
                    if places := _phrase_places(line, phrase):
                        base += places
                        labels.add(label)
                near = finder.find(line[1:-1].decode())
                scores = [1.0] * bool(base) + [
                    1 - edits / len(notices[label]) for label, _, _, edits in near
                ]
                rows.append((
                    doc, len(words), len(base), min(base, default=None), max(base, default=None),
                    ",".join(sorted(labels)), ",".join(sorted(labels | {x[0] for x in near})),
                    min(1.0, max(scores, default=0.0)),
                    [{"label": a, "start": b, "end": c, "edits": d} for a, b, c, d in near],
                ))
            columns = list(zip(*rows)) or [()] * len(ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW)], schema=ARROW)

    return run


ARROW = pa.schema([
    ("doc", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
    ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("notices", pa.list_(pa.struct([
        ("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32()),
    ]))),
])
_SCHEMA = (
    "doc long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, notices array<struct<label: string, start: int, end: int, edits: int>>"
)


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: Mapping[str, str] = PHRASES,
    notices: Mapping[str, str] = NOTICES,
    chars_per_edit: int = CHARS_PER_EDIT,
    max_edits: int = MAX_EDITS,
) -> DataFrame:
    """Per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, notices.

    Whole texts, A-Z lower-cased, as words of letters, digits and non-ASCII. n_base counts all
    places where the words of a phrase stand side by side; first_word and last_word are the
    smallest and largest of their first words, null without any. ``notices`` lists matches
    of the notices with bounded edits, as spans of the words joined by single spaces that do not
    overlap others of their label; labels
    joins their labels to those of the phrases. score is 1 for a phrase, else 1 minus edits
    over the notice's length for the best notice, 0 without any.

    Null or empty texts have no words. Every row is scanned alone: null ids, repeated rows and
    further columns make no difference, nothing is shuffled. An empty table gives an empty table.
    """
    found = docs.select(
        F.col(id_col).cast("long").alias("doc"), text_or_empty(F.col(text_col)).cast("binary").alias("text")
    ).mapInArrow(_scan_task(phrases, notices, chars_per_edit, max_edits), _SCHEMA)
    return found.withColumnRenamed("doc", id_col)

