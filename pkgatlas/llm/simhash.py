"""SimHash near-duplicates: exact tile-by-tile comparison of 64-bit fingerprints."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgatlas.llm.common import components, keep_first, place, store, text_or_empty

SHINGLE = 3
SEED = 42
RADIUS = 3
#: A pair of tiles is one row of at most 8 KB, so a batch of rows stays small in a task.
TILE_ROWS = 512


def shingle_hashes(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 hashes of the shingles in their order; a text shorter than a shingle is one."""
    words = text.lower().split()  # of bytes: A-Z, and the six ASCII white space characters
    if not words:
        return np.empty(0, "<u8")
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(line, seed)], dtype="<u8")
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    return np.array(
        [xxhash.xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())],
        dtype="<u8",
    )


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit i is set when over half of the shingles' XXH64 hashes have it set."""
    return majority_bits(shingle_hashes(text, shingle, seed))


def majority_bits(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have set."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprint_task(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array(
                [fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)], dtype=np.uint64
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc", "fp"])

    return run


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED
) -> DataFrame:
    """(doc long, fp long) of whole texts; a text without words, or a null one, has 0."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc"), text_or_empty(F.col(text_col)).cast("binary").alias("text")
    ).mapInArrow(_fingerprint_task(shingle, seed), "doc long, fp long")


def neighbour_offsets(parts: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of population counts that a pair within ``radius`` can have; one of +d and -d."""
    near = [
        d for d in itertools.product(range(-radius, radius + 1), repeat=parts)
        if sum(map(abs, d)) <= radius
    ]
    return [d for d in near if d >= tuple([0] * parts)]


def _population(fp: Column, parts: int) -> list[Column]:
    if parts == 1:
        return [F.bit_count(fp).cast("int")]
    width = 64 // parts
    mask = F.lit((1 << width) - 1)
    return [
        F.bit_count(F.shiftrightunsigned(fp, width * p).bitwiseAND(mask)).cast("int") for p in range(parts)
    ]


def _key(counts: list[Column]) -> Column:
    key = F.lit(0).cast("long")
    for c in counts:
        key = key * 128 + c
    return key


class _Forest:
    """Links among 64-bit nodes, kept as a spanning forest; a dense group of n leaves n - 1."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            low, high = min(a, b), max(a, b)
            self.parent[high] = low
            self.parent.setdefault(low, low)

    def edges(self) -> pa.RecordBatch:
        pairs = [(x, self.find(x)) for x in list(self.parent)]
        pairs = [p for p in pairs if p[0] != p[1]]
        return pa.RecordBatch.from_arrays(
            [pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"]
        )


def _link(left: np.ndarray, right: np.ndarray, radius: int, forest: _Forest, same: bool) -> None:
    """Compare two tiles exactly; new links go to the forest."""
    la, lb = left.view(np.int64), right.view(np.int64)
    step = max(1, (1 << 18) // max(1, len(right)))
    for at in range(0, len(left), step):
        near = np.bitwise_count(left[at : at + step, None] ^ right[None, :]) <= radius
        i, j = np.nonzero(near)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        # one link for each pair of groups is enough, and none inside a group
        while len(i):
            rows, cols = np.unique(i), np.unique(j)
            a, b = np.empty(len(left), np.int64), np.empty(len(right), np.int64)
            a[rows] = [forest.find(x) for x in la[rows].tolist()]
            b[cols] = [forest.find(x) for x in lb[cols].tolist()]
            apart = a[i] != b[j]
            i, j = i[apart], j[apart]
            if len(i):
                for x, y in np.unique(np.stack([a[i], b[j]]), axis=1).T.tolist():
                    forest.join(x, y)


def _compare_task(radius: int, max_nodes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        for batch in batches:
            for row in range(batch.num_rows):
                left, right = (np.frombuffer(batch.column(c)[row].as_py(), np.uint64) for c in range(2))
                _link(left, right, radius, forest, batch.column(2)[row].as_py())
                if len(forest.parent) > max_nodes:
                    yield forest.edges()
                    forest = _Forest()
        yield forest.edges()

    return run


def _tile(_key_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One tile's fingerprints as bytes; at most about a tile's rows."""
    table = pa.Table.from_batches(list(batches))
    yield pa.RecordBatch.from_arrays([
        pa.array([table.column("key")[0].as_py()], pa.int64()), pa.array([table.column("block")[0].as_py()], pa.int32()),
        pa.array([np.sort(table.column("fp").to_numpy()).tobytes()]),
    ], ["key", "block", "fps"])


def near_links(
    prints: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS, parts: int | None = None
) -> DataFrame:
    """(a, b): enough links to connect all of ``prints`` (fp, each once) within ``radius`` bits.

    Fingerprints are filed into tiles by the population counts of their ``parts`` equal parts;
    two that differ in d bits have counts that differ by d in sum at most, so all other tile
    pairs are skipped. A tile with more than ``tile_rows`` is cut into blocks. Every remaining
    pair of blocks is compared in full with exclusive-or and bit counts. Inside a task links
    are kept as a forest, so a dense group gives no more rows than it has members. ``parts``
    (1, 2 or 4) only sets how finely tiles are cut; the links are the same.
    """
    spark = prints.sparkSession
    n = prints.count()
    if parts is None:
        parts = 4 if n > 200_000 else 2 if n > 10_000 else 1
    counts = _population(F.col("fp"), parts)
    keyed = prints.select("fp", _key(counts).alias("key"))
    sizes = keyed.groupBy("key").agg(F.ceil(F.count("*") / F.lit(tile_rows)).cast("int").alias("blocks"))
    # a row per combination of counts: 17 ** 4 at most
    sizes, _ = store(sizes, "tile-sizes")
    tiles, _ = store(
        keyed.join(F.broadcast(sizes), "key")
        .select("fp", "key", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("block"))
        .groupBy("key", "block").applyInArrow(_tile, "key long, block int, fps binary"),
        "tiles",
    )
    offsets = [sum(x * 128 ** (parts - 1 - p) for p, x in enumerate(d)) for d in neighbour_offsets(parts, radius)]
    # each block meets the blocks of its own tile that do not come before it, and those of the
    # neighbouring tiles on one side; the other block's number is part of the join key, so the
    # blocks of one full tile spread over tasks
    sent = tiles.select(
        F.col("fps").alias("lf"), F.col("block").alias("from_block"),
        F.col("key").alias("from_key"), F.explode(F.array(*[F.lit(o).cast("long") for o in offsets])).alias("o"),
    )
    met = (
        sent.withColumn("key", F.col("from_key") + F.col("o"))
        .join(F.broadcast(sizes), "key")
        .withColumn("block", F.explode(F.sequence(
            F.when(F.col("o") == 0, F.col("from_block")).otherwise(F.lit(0)), F.col("blocks") - 1
        )))
        .join(tiles, ["key", "block"])
        .select("lf", "fps", ((F.col("o") == 0) & (F.col("from_block") == F.col("block"))).alias("same"))
    )
    return met.mapInArrow(_compare_task(radius, 1_000_000), "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    seed: int = SEED,
    radius: int = RADIUS,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Per document: id, fingerprint (16 hex digits), component_id.

    Texts are lower-cased (A-Z), cut into words and shingles, repeats included; a text shorter
    than a shingle is one shingle, one without words (or null) has fingerprint zero. Documents
    whose fingerprints differ in ``radius`` bits or fewer are linked; component_id is the
    smallest id reachable. Equal fingerprints are folded into one before any comparison, so a
    group of copies costs one row. Rows with a null id have a fingerprint, no component of
    their own, and the smallest id of the documents they reach (null if all are null). Rows
    with the same id are told apart by fingerprint. Further columns are ignored; an empty
    table gives an empty table.
    """
    prints, _ = store(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    nodes, _ = store(
        prints.groupBy("fp").agg(F.min("doc").alias("least")), "nodes"
    )
    links = near_links(nodes.select("fp"), radius, tile_rows)
    linked = components(links).join(nodes, F.col("node") == F.col("fp"))
    # one row per node; the smallest document of each component, combined before the shuffle
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    named = linked.select("node", "root").join(least, "root").select(F.col("node").alias("fp"), "component")
    classes, _ = store(
        nodes.select("fp", "least").join(named, "fp", "left")
        .select("fp", F.coalesce("component", "least").alias("component_id")),
        "classes",
    )
    return prints.join(classes, "fp").select(
        F.col("doc").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    seed: int = SEED,
    radius: int = RADIUS,
) -> DataFrame:
    """``docs`` with one row of each component: the smallest id, then the smallest text hash, all columns.

    Each row is judged by its id and text hash, so unlike texts under one id are told apart. Rows
    with a null id take part and come last; rows with the same id and text stay once.
    """
    marked = docs.select(F.xxhash64(text_or_empty(F.col(text_col))).alias("__mark"), text_col)
    classes = near_duplicates(marked, "__mark", text_col, shingle, seed, radius)
    named = classes.select(F.col("__mark").alias("mark"), F.col("component_id").alias("class")).distinct()
    members, _ = store(docs.select(*place(id_col, text_col)).join(named, "mark"), "near-members")
    return keep_first(docs, members, id_col, text_col)
