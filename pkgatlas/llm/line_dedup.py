"""Line dedup: two Bloom filters find suspected repeats, only those are shuffled."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgatlas.llm.common import WHITE, store, text_or_empty

MIN_KEY = 10
PROBES = 4
BITS_PER_LINE = 8
MAX_BITS = 1 << 30
SEGMENT_BYTES = 1 << 16
_WHITE = WHITE.encode()


def line_keys(text: bytes, min_key: int = MIN_KEY) -> list[tuple[int, bytes]]:
    """(line number, key) of the lines whose key is long enough."""
    found = []
    for at, line in enumerate(text.split(b"\n")):
        key = line.strip(_WHITE).lower()  # of bytes: A-Z only
        if len(key) >= min_key and (len(key) >= 4 * min_key or len(key.decode()) >= min_key):
            found.append((at, key))
    return found


def _probes(hashes: np.ndarray, bits: int, probes: int) -> np.ndarray:
    """Bit positions, one row per probe, from the two halves of each 128-bit hash."""
    step = hashes[:, 1] | np.uint64(1)
    return np.stack([(hashes[:, 0] + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(probes)])


def _held(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    held = np.ones(places.shape[1], dtype=bool)
    for p in places:
        held &= (bitmap[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return held


def _mark(bitmap: np.ndarray, places: np.ndarray) -> None:
    flat = places.ravel()
    at, bit = (flat >> np.uint64(3)).astype(np.int64), (flat & np.uint64(7)).astype(np.uint8)
    for b in range(8):
        bitmap[at[bit == b]] |= np.uint8(1 << b)  # equal places write equal bytes


def _digests(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), dtype="<u8").reshape(-1, 2)


def _segments(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    number, once, twice = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(number, pa.int32()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())],
        ["segment", "once", "twice"],
    )


def _filter_task(bits: int, probes: int, min_key: int):
    """Per task: which hashes it saw in one document, and in two or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                keys: list[bytes] = []
                for text in batch.column(0).slice(start, 256):
                    keys += {k for _, k in line_keys(text.as_py() or b"", min_key)}
                if not keys:
                    continue
                _, first, count = np.unique(
                    hashes := _digests(keys), axis=0, return_index=True, return_counts=True
                )
                places = _probes(hashes[first], bits, probes)
                _mark(twice, places[:, (count > 1) | _held(once, places)])
                _mark(once, places)
        rows = []
        for s in range(0, bits // 8, SEGMENT_BYTES):
            part = once[s : s + SEGMENT_BYTES]
            if part.any():
                pair = [zlib.compress(x.tobytes(), 1) for x in (part, twice[s : s + SEGMENT_BYTES])]
                rows.append((s // SEGMENT_BYTES, *pair))
                if len(rows) == 64:
                    yield _segments(rows)
                    rows = []
        if rows:
            yield _segments(rows)

    return run


def _merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two tasks that both hold a hash make it seen twice: their filters' common bits join."""
    once = twice = None
    for batch in batches:
        for a, b in zip(batch.column("once"), batch.column("twice")):
            a, b = (np.frombuffer(zlib.decompress(x.as_py()), np.uint8) for x in (a, b))
            if once is None:
                once, twice = a.copy(), b.copy()
            else:
                twice |= b | (once & a)
                once |= a
    yield pa.RecordBatch.from_arrays(
        [pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(twice.tobytes(), 1)])],
        ["segment", "twice"],
    )


def twice_seen(
    texts: DataFrame, bits: int, probes: int = PROBES, min_key: int = MIN_KEY, tasks: int | None = None
) -> np.ndarray:
    """The Bloom filter of line hashes seen in two or more documents; ``bits / 8`` bytes.

    ``texts`` has one column. Each task fills its own pair of filters; they are merged segment
    by segment. Few tasks build many filters' worth of text, since each sends its own.
    """
    tasks = tasks or 4 * texts.sparkSession.sparkContext.defaultParallelism
    pairs = texts.coalesce(tasks).mapInArrow(
        _filter_task(bits, probes, min_key), "segment int, once binary, twice binary"
    )
    merged = pairs.groupBy("segment").applyInArrow(_merge, "segment int, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    # bits / 8 bytes at most, whatever the input's size
    for segment, part in merged.collect():
        at = segment * SEGMENT_BYTES
        got = np.frombuffer(zlib.decompress(bytes(part)), np.uint8)
        out[at : at + len(got)] = got
    return out


def _suspect_task(filter_of, bits: int, probes: int, min_key: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(filter_of.value, np.uint8)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                ids, marks, where, keys = [], [], [], []
                part = batch.slice(start, 256)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                    text = text.as_py() or b""
                    at: dict[bytes, list[int]] = {}
                    for n, key in line_keys(text, min_key):
                        at.setdefault(key, []).append(n)
                    if at:
                        mark = xxhash.xxh64_intdigest(text, 42)
                        keys += at.keys()
                        where += at.values()
                        ids += [doc] * len(at)
                        marks += [mark] * len(at)
                if not keys:
                    continue
                hashes = _digests(keys)
                hit = np.flatnonzero(_held(twice, _probes(hashes, bits, probes)))
                if len(hit):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([ids[i] for i in hit], schema.field(0).type),
                        pa.array(np.array([marks[i] for i in hit], np.uint64).view(np.int64)),
                        pa.array(hashes[hit, 0].view(np.int64)), pa.array(hashes[hit, 1].view(np.int64)),
                        pa.array([where[i] for i in hit], pa.list_(pa.int32())),
                    ], schema=schema)

    return run


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_key: int = MIN_KEY,
    bits_per_line: int = BITS_PER_LINE,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text_col``, plus n_lines and n_dropped.

    A line's key is the line without outer white space, A-Z lower-cased. A key of ``min_key``
    code points or more that two or more documents hold loses all its lines except in the
    document with the smallest id. Other lines stay, joined by a line feed.

    One pass fills the filters, one sends the suspects (id, 128-bit hash, line numbers) that
    the twice-seen filter holds; their smallest and largest ids, combined before the shuffle,
    confirm or clear them, so a false hit of the filter costs a row and never a line. The
    filter has ``bits_per_line`` bits a line up to ``max_bits`` (128 MiB sent to each
    executor); beyond that more lines become suspects, with the same result. Keys count as
    equal when their XXH3 128-bit hashes are.

    Ids are whole numbers. Null or empty text is one empty line. Rows with the same id are one document. Rows with a
    null id count for no other document and stay as they are. Further columns stay; columns
    named n_lines or n_dropped are replaced. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    text = text_or_empty(F.col(text_col))
    binary = text.cast("binary")
    n_lines = F.size(F.split(text, "\n", -1)).cast("long")
    total = docs.agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)).first()[0]
    bits = min(max_bits, max(1 << 19, 1 << (bits_per_line * (total or 0)).bit_length()))
    known = docs.filter(F.col(id_col).isNotNull())
    filter_of = spark.sparkContext.broadcast(
        twice_seen(known.select(binary), bits, min_key=min_key).tobytes()
    )
    ids = known.select(F.col(id_col).cast("long").alias("doc"), binary.alias("text"))
    schema = "doc long, mark long, k1 long, k2 long, at array<int>"
    arrow = pa.schema([
        *[(c, pa.int64()) for c in ("doc", "mark", "k1", "k2")], ("at", pa.list_(pa.int32())),
    ])
    suspects, _ = store(
        ids.mapInArrow(_suspect_task(filter_of, bits, PROBES, min_key, arrow), schema), "suspects"
    )
    # exact confirmation: a key is repeated when its smallest and largest document differ
    first = suspects.groupBy("k1", "k2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    # stored, so that the join below reads both sides as they are: its skew can then be split
    repeated, _ = store(first.filter("first < last").select("k1", "k2", "first"), "repeated")
    # a set: rows that repeat a document repeat its line numbers; bounded by its lines
    drops = (
        suspects.join(repeated, ["k1", "k2"]).filter("doc > first")
        .groupBy("doc", "mark").agg(F.flatten(F.collect_set("at")).alias("lost"))
    )
    held = docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("r"), F.col(id_col).cast("long").alias("doc"),
        F.xxhash64(binary).alias("mark"),
    )
    joined = held.join(drops.hint("shuffle_hash"), ["doc", "mark"], "left").select(
        "r", F.array_distinct("lost").alias("lost"), F.split(text_or_empty(F.col("r")[text_col]), "\n", -1).alias("lines")
    )
    kept = F.array_join(
        F.transform(
            F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost")),
            lambda i: F.get("lines", i),
        ),
        "\n",
    )
    new = {
        text_col: F.when(F.col("lost").isNull(), text_or_empty(F.col("r")[text_col])).otherwise(kept),
        "n_lines": F.size("lines").cast("long"),
        "n_dropped": F.coalesce(F.size("lost"), F.lit(0)).cast("long"),
    }
    return joined.select(
        *[(new[c] if c in new else F.col("r")[c]).alias(c) for c in docs.columns],
        *[new[c].alias(c) for c in new if c not in docs.columns],
    )
