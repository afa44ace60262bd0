"""Benchmark decontamination: a generalised suffix automaton of the test items reads training texts.

The automaton of all items' words is walked once along a document; at each word it knows the
longest run that ends there and stands in some item. Runs of ``window`` words and more, and
whole items that are shorter, are hit.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType

from pkgatlas.llm.common import LOWER, UPPER, running_total, store, text_or_empty

WINDOW = 10
#: Item words in one automaton, which is sent to every executor: 64 MB at most.
AUTOMATON_WORDS = 500_000
#: A longer item is cut into pieces that overlap, so that no window is lost.
PIECE_WORDS = 50_000
_OTHER = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Bytes of a text to those of its words: A-Z lower-cased, digits and non-ASCII kept, the rest spaces.
_TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_WORD_BYTES = re.compile(rb"[^ ]+")
_PAIR_BITS = 22
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of_item(text: Column) -> Column:
    lowered = F.translate(text_or_empty(text), UPPER, LOWER)
    return F.array_remove(F.split(lowered, _OTHER, -1), "")


class Automaton:
    """Generalised suffix automaton of word sequences, each with an item's name.

    ``follow`` maps state * n_words + word to the next state, ``link`` is the state of the
    longest suffix in another class, ``length`` the longest run of a state's class.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        vocabulary: dict[bytes, int] = {}
        coded = [(name, [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]) for name, words in items]
        n_words = len(vocabulary) + 1
        edges: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        for _, words in coded:
            last = 0
            for w in words:
                last = self._extend(edges, link, length, last, w)
        # items at the states of their windows; a shorter item at the state of its whole run
        at_window: dict[int, set[int]] = {}
        short: dict[int, dict[int, set[int]]] = {}
        for number, (_, words) in enumerate(coded):
            state = 0
            for n, w in enumerate(words, 1):
                state = edges[state][w]
                while length[link[state]] >= window:
                    state = link[state]
                if n >= window:
                    at_window.setdefault(state, set()).add(number)
            if 0 < len(words) < window:
                short.setdefault(state, {}).setdefault(len(words), set()).add(number)
        flat = [(s * n_words + w, t) for s, out in enumerate(edges) for w, t in out.items()]
        pairs = {(a, b) for _, words in coded for a, b in zip(words, words[1:])}
        self.names = [name for name, _ in coded]
        self.vocabulary, self.link, self.length = vocabulary, link, length
        self.follow = dict(flat)
        self.at_window, self.short = at_window, short
        self.pairs = np.array([a * n_words + b for a, b in pairs], np.uint64)
        self.least = min((min(len(words), window) for _, words in coded if words), default=window)
        self._prepare()

    @staticmethod
    def _extend(edges: list[dict[int, int]], link: list[int], length: list[int], last: int, w: int) -> int:
        """The state of ``last``'s run with ``w`` after it, made where it is not there yet."""

        def split(p: int, q: int) -> int:
            """The class of runs of q that are no longer than p's and one word."""
            if length[q] == length[p] + 1:
                return q
            edges.append(dict(edges[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            clone = len(edges) - 1
            link[q] = clone
            while p >= 0 and edges[p].get(w) == q:
                edges[p][w] = clone
                p = link[p]
            return clone

        if w in edges[last]:
            return split(last, edges[last][w])
        edges.append({})
        link.append(0)
        length.append(length[last] + 1)
        new, p = len(edges) - 1, last
        while p >= 0 and w not in edges[p]:
            edges[p][w] = new
            p = link[p]
        if p >= 0:
            link[new] = split(p, edges[p][w])
        return new

    def _prepare(self) -> None:
        n_words = len(self.vocabulary) + 1
        self.n_words = n_words
        self.known_pairs = np.zeros(1 << _PAIR_BITS, bool)
        self.known_pairs[self._slots(self.pairs)] = True
        # the nearest state on the way up, itself included, where a short item ends
        order = sorted(range(len(self.link)), key=self.length.__getitem__)
        self.nearest = [-1] * len(self.link)
        for s in order:
            self.nearest[s] = s if s in self.short else self.nearest[self.link[s]] if s else -1

    @staticmethod
    def _slots(pairs: np.ndarray) -> np.ndarray:
        return ((pairs * _MULTIPLIER) >> np.uint64(64 - _PAIR_BITS)).astype(np.int64)

    def to_bytes(self) -> bytes:
        """Arrays and names, without the tables that ``from_bytes`` derives."""
        keys = np.fromiter(self.follow, np.int64, len(self.follow))
        values = np.fromiter(self.follow.values(), np.int32, len(self.follow))
        return pickle.dumps((
            self.window, self.names, b" ".join(self.vocabulary), np.array(self.link, np.int32),
            np.array(self.length, np.int32), keys, values, self.at_window, self.short, self.pairs, self.least,
        ), protocol=5)

    @classmethod
    def from_bytes(cls, data: bytes) -> Automaton:
        self = cls.__new__(cls)
        (self.window, self.names, vocabulary, link, length, keys, values, self.at_window, self.short, self.pairs,
         self.least) = pickle.loads(data)
        self.vocabulary = {w: n for n, w in enumerate(vocabulary.split(), 1)}
        self.link, self.length = link.tolist(), length.tolist()
        self.follow = dict(zip(keys.tolist(), values.tolist()))
        self._prepare()
        return self

    def _stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Where windows may lie: runs of words, two by two side by side in some item.

        Elsewhere the walk is back at the start, so those words need no step.
        """
        if self.least > 1:
            ids = ids.astype(np.uint64)
            near = self.known_pairs[self._slots(ids[:-1] * np.uint64(self.n_words) + ids[1:])]
            near &= (ids[:-1] > 0) & (ids[1:] > 0)
            least = self.least - 1
        else:
            near, least = ids > 0, 1
        edge = np.flatnonzero(np.diff(np.concatenate([[False], near, [False]]).astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        wide = end - begin >= least
        return list(zip(begin[wide].tolist(), (end[wide] + (self.least > 1)).tolist()))

    def hits(self, words: list[bytes]) -> tuple[list[list[int]], set[int]]:
        """Spans [start, end) of hit words, apart and in order, and the numbers of the items found."""
        spans: list[list[int]] = []
        found: set[int] = set()
        if len(words) < self.least:
            return spans, found
        ids = np.fromiter(map(self.vocabulary.get, words, [0] * len(words)), np.int64, len(words))
        follow, link, length, n_words, window = self.follow.get, self.link, self.length, self.n_words, self.window
        nearest, short = self.nearest, self.short
        seen: set[int] = set()

        def add(start: int, end: int) -> None:
            while spans and spans[-1][1] >= start:
                start = min(start, spans.pop()[0])
            spans.append([start, end])

        for begin, end in self._stretches(ids):
            state = run = 0
            for at, w in enumerate(ids[begin:end].tolist(), begin + 1):
                following = follow(state * n_words + w)
                while following is None and state:
                    state = link[state]
                    run = length[state]
                    following = follow(state * n_words + w)
                if following is None:
                    run = 0
                    continue
                state = following
                run += 1
                if run >= window:
                    add(at - run, at)
                    top = state
                    while length[link[top]] >= window:
                        top = link[top]
                    seen.add(top)
                ends = nearest[state]
                while ends >= 0:
                    for size, items in short[ends].items():
                        if size <= run:
                            add(at - size, at)
                            found |= items
                    ends = nearest[link[ends]]
        for state in seen:
            found |= self.at_window[state]
        return spans, found


def _build(key: tuple, batches: Iterator[pa.RecordBatch], window: int = WINDOW) -> Iterator[pa.RecordBatch]:
    items = [
        (name, [w.encode() for w in words])
        for b in batches
        for name, words in zip(b.column("name").to_pylist(), b.column("words").to_pylist())
    ]
    yield pa.RecordBatch.from_arrays(
        [pa.array([key[0].as_py()], pa.int64()), pa.array([Automaton(items, window).to_bytes()], pa.binary())],
        ["shard", "data"],
    )


def build_automata(
    items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW,
    automaton_words: int = AUTOMATON_WORDS, piece_words: int = PIECE_WORDS,
) -> DataFrame:
    """(shard, data): automata over at most about ``automaton_words`` item words each, built in tasks.

    An item above ``piece_words`` is cut into pieces that share ``window`` - 1 words. Items without
    words are left out.
    """
    whole = items.select(F.col(id_col).cast("string").alias("name"), words_of_item(F.col(text_col)).alias("all"))
    last = F.greatest(F.size("all") - window, F.lit(0))
    pieces, _ = store(
        whole.filter(F.size("all") > 0)
        .select("name", "all", F.explode(F.sequence(F.lit(0), last, F.lit(piece_words))).alias("at"))
        .select("name", F.slice("all", F.col("at") + 1, piece_words + window - 1).alias("words"))
        .withColumn("n", F.size("words").cast("long")),
        "item-pieces",
    )
    total = pieces.agg(F.sum("n")).first()[0] or 0
    if total <= automaton_words:
        dealt = pieces.withColumn("shard", F.lit(0).cast("long"))
    else:
        room = max(1, automaton_words - piece_words - window)
        dealt = running_total(pieces, ["name"], "n", "before").withColumn("shard", (F.col("before") / room).cast("long"))

    def build(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _build(key, batches, window)

    built, _ = store(
        dealt.select("shard", "name", "words").groupBy("shard").applyInArrow(build, "shard long, data binary"), "automata"
    )
    return built


def _cut(text: bytes, spans: list[list[int]]) -> bytes:
    """``text`` without the spans of its words; what stands between them and the next word stays."""
    places = [m.span() for m in _WORD_BYTES.finditer(text.translate(_TO_WORDS))]
    parts, at = [], 0
    for start, end in spans:
        parts.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join(parts) + text[at:]


_RESULT = "n_words long, n_hit long, spans array<struct<start:long,end:long>>, items array<string>"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _read_task(automaton_of, id_type: pa.DataType, hit_only: bool):
    held: list[Automaton] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(Automaton.from_bytes(automaton_of.value))
        automaton = held[0]
        for batch in batches:
            keep, n_words, n_hit, spans, items = [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                words = text.as_py().translate(_TO_WORDS).split()
                where, found = automaton.hits(words)
                if hit_only and not where:
                    continue
                keep.append(row)
                n_words.append(len(words))
                n_hit.append(sum(e - s for s, e in where))
                spans.append([{"start": s, "end": e} for s, e in where])
                items.append(sorted({automaton.names[i] for i in found if automaton.names[i] is not None}))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(keep, pa.int64())).cast(id_type), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                pa.array(spans, pa.list_(_SPAN)), pa.array(items, pa.list_(pa.string())),
            ], ["row", "n_words", "n_hit", "spans", "items"])

    return run


def _union_spans(spans: Column) -> Column:
    """Spans of several automata as spans that lie apart."""
    ordered = F.array_sort(spans)
    start = F.array().cast("array<struct<start:long,end:long>>")

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        return F.when(
            (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["start"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(ordered, start, step)


def benchmark_overlap(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    automaton_words: int = AUTOMATON_WORDS,
    piece_words: int = PIECE_WORDS,
) -> DataFrame:
    """Per row of ``docs``: its id, n_words, n_hit, spans of hit words [start, end), items (names, sorted).

    Words are runs of digits, a-z (A-Z lower-cased) and characters beyond ASCII. A window is
    ``window`` consecutive words of one item; an item of fewer words, but not none, is one
    window. Every word inside an occurrence of a window is hit; ``items`` are those with an
    occurring window. Texts are read once per automaton and never shuffled while one automaton
    holds all items; it is sent to the executors, at most ``automaton_words`` words of it.
    More items make more automata: their passes leave only rows that are hit, and those are
    joined by row.

    Null or empty text has no words. Rows with the same id, repeated rows and null ids are
    judged each on their own. Items with the same id are one item; one with a null id hits
    words but is not named. Items without words do nothing; with no items nothing is hit.
    Further columns are ignored; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    built = build_automata(items, item_id, item_text, window, automaton_words, piece_words)
    shards = [r[0] for r in built.select("shard").orderBy("shard").collect()]  # one number per automaton
    text = text_or_empty(F.col(text_col)).cast("binary").alias("text")
    key = F.struct(F.col(id_col).cast("string").alias("id"), F.xxhash64(text).alias("h1"), F.crc32(text).alias("h2"))

    def pass_over(shard: int | None, row: Column, hit_only: bool) -> DataFrame:
        if shard is None:
            data = Automaton([], window).to_bytes()
        else:
            data = bytes(built.filter(F.col("shard") == shard).first()["data"])  # bounded by automaton_words
        sent = spark.sparkContext.broadcast(data)
        rows = docs.select(row.alias("row"), text)
        schema = StructType([rows.schema["row"], *StructType.fromDDL(_RESULT).fields])
        return rows.mapInArrow(_read_task(sent, to_arrow_type(rows.schema["row"].dataType), hit_only), schema)

    if len(shards) <= 1:
        one = pass_over(shards[0] if shards else None, F.col(id_col), False)
        return one.withColumnRenamed("row", id_col)
    hit = None
    for shard in shards:
        part, _ = store(pass_over(shard, key, True), "shard-hits")
        hit = part if hit is None else hit.unionByName(part)
    # rows alike in id and text have the same hits, so each needs them once
    once = hit.groupBy("row").agg(F.flatten(F.collect_set("spans")).alias("s"), F.flatten(F.collect_set("items")).alias("i"))
    once = once.select("row", _union_spans(F.col("s")).alias("spans"), F.array_sort(F.array_distinct("i")).alias("items"))
    counted = docs.select(F.col(id_col), key.alias("row"), F.size(words_of_item(F.col(text_col))).cast("long").alias("n_words"))
    none = F.array().cast("array<struct<start:long,end:long>>")
    joined = counted.join(once, counted["row"].eqNullSafe(once["row"]), "left").select(
        id_col, "n_words", F.coalesce("spans", none).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"])
    return joined.select(id_col, "n_words", n_hit.alias("n_hit"), "spans", "items")


def _clean_task(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                None if t is None else _cut(t, [[s["start"], s["end"]] for s in spans]).decode()
                for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], schema=schema)

    return run


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    max_coverage: float = 0.5,
) -> DataFrame:
    """``docs`` without the hit spans; rows whose hit words exceed ``max_coverage`` of all are left out.

    A span is cut from its first word's first character to its last word's last one; what stands
    around it stays. Rows that are not hit stay as they are, a null text included. All columns
    are kept as they are, whatever their names.
    """
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row_"), F.col(text_col).alias("text"))
    kept = benchmark_overlap(whole, items, "row_", "text", item_id, item_text, window).filter(
        F.col("n_hit") <= F.lit(max_coverage) * F.col("n_words")
    )
    kind = whole.schema["row_"].dataType
    arrow = pa.schema([("row_", to_arrow_type(kind)), ("new", pa.string())])
    cut = kept.select("row_", F.col("row_")[text_col].cast("binary").alias("text"), "spans").mapInArrow(
        _clean_task(arrow), StructType([StructField("row_", kind), StructField("new", StringType())])
    )
    return cut.select(*[F.col("new").alias(c) if c == text_col else F.col("row_")[c].alias(c) for c in docs.columns])
