"""Near copies by the exact Jaccard similarity of word shingles.

SimHash fingerprints within RADIUS bits are tested first; MinHash bands find the similar pairs that lie further apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgatlas.llm.common import components, keep_first, place, store, text_or_empty
from pkgatlas.llm.simhash import RADIUS, _Forest, majority_bits, near_links, shingle_hashes

SHINGLE = 5
SEED = 42
#: Similarity of 4 / 5 and more.
SHARE = (4, 5)
#: A pair at 0.8 shares a band with probability 1 - (1 - 0.8 ** 5) ** 25 = 0.99995, a closer one more surely.
BANDS, DEPTH = 25, 5
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS * DEPTH, 1), np.uint64) * np.uint64(2) + np.uint64(1)
#: Hashes in one step: the products stay in the cache.
_STEP = 512
#: Hashes in one batch that leaves a task.
_BATCH = 1 << 20
#: Members of a band that meet in a join; those of a larger band meet in tiles.
SMALL_BAND = 16
#: Sets in one tile of a band, and hashes in them; a tile is one row of at most about 4 MB.
TILE_SETS, TILE_HASHES = 256, 1 << 18
#: Shared hashes counted at a time.
_COLUMNS = 4096


def shingle_set(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Hashes of a text's shingles, sorted, each once."""
    return np.unique(shingle_hashes(text, shingle, seed))


def bands(hashes: np.ndarray) -> list[int]:
    """One key for each band of the set's least products."""
    least = np.full(BANDS * DEPTH, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), _STEP):
        np.minimum(least, (_FACTORS * hashes[None, at : at + _STEP]).min(axis=1), out=least)
    width = DEPTH * 8
    data = least.tobytes()
    keys = [xxhash.xxh64_intdigest(data[b * width : (b + 1) * width], b) for b in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _print_task(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, keys, prints = [], [], [], []
            for text in batch.column(2):
                hashes = shingle_set(text.as_py(), shingle, seed)
                prints.append(majority_bits(hashes))  # of the set, so equal sets have one
                nodes.append(xxhash.xxh64_intdigest(hashes.tobytes(), seed))
                sizes.append(len(hashes))
                keys.append(bands(hashes))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)),
                pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())),
                pa.array(np.array(prints, np.uint64).view(np.int64)),
            ], ["doc", "mark", "node", "n", "bands", "fp"])

    return run


def _set_task(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"]
            )

        nodes, sets, held = [], [], 0
        for batch in batches:
            for node, text in zip(batch.column(0), batch.column(1)):
                sets.append(shingle_set(text.as_py(), shingle, seed).view(np.int64))
                nodes.append(node.as_py())
                held += len(sets[-1])
                if held > _BATCH:
                    yield out()
                    nodes, sets, held = [], [], 0
        yield out()

    return run


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose sets have a Jaccard similarity of SHARE or more."""
    p, q = SHARE
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb"))
    return (
        pairs.join(left, "a").join(right, "b")
        .filter(both * (p + q) >= (F.size("ha") + F.size("hb")) * p)
        .select("a", "b")
    )


def _set_tile(_key_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One tile's nodes, roots, set sizes and hashes as bytes."""
    table = pa.Table.from_batches(list(batches))
    hashes = table.column("hashes").combine_chunks()
    columns = [table.column(c).to_numpy() for c in ("node", "root", "n")] + [hashes.flatten().to_numpy()]
    yield pa.RecordBatch.from_arrays([
        pa.array([table.column("key")[0].as_py()], pa.int64()), pa.array([table.column("block")[0].as_py()], pa.int32()),
        *[pa.array([c.astype(np.int64).tobytes()], pa.binary()) for c in columns],
    ], ["key", "block", "nodes", "roots", "sizes", "hashes"])


def shared_counts(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many hashes each set on the left shares with each on the right; a side is (sizes, hashes)."""
    both = np.intersect1d(left[1], right[1])
    rows = [np.repeat(np.arange(len(sizes)), sizes) for sizes, _ in (left, right)]
    out = np.zeros((len(left[0]), len(right[0])), np.int64)
    places = []
    for hashes in (left[1], right[1]):
        at = np.searchsorted(both, hashes)
        at[at == len(both)] = 0
        places.append(np.where(both[at] == hashes, at, -1) if len(both) else np.full(len(hashes), -1))
    for first in range(0, len(both), _COLUMNS):
        sides = []
        for row, at, n in zip(rows, places, out.shape):
            some = (at >= first) & (at < first + _COLUMNS)
            held = np.zeros((n, min(_COLUMNS, len(both) - first)), np.float32)
            held[row[some], at[some] - first] = 1
            sides.append(held)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def _meet_task(max_nodes: int = 1_000_000):
    """Exact similarity of all pairs of two tiles that lie in different groups; a forest of groups leaves."""
    p, q = SHARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        for batch in batches:
            for row in range(batch.num_rows):
                cells = [np.frombuffer(batch.column(c)[row].as_py(), np.int64) for c in range(6)]
                roots, sizes = [np.array([forest.find(x) for x in cells[c].tolist()]) for c in (0, 3)], cells[1::3]
                apart = roots[0][:, None] != roots[1][None, :]
                low, high = np.minimum.outer(*sizes), np.maximum.outer(*sizes)
                apart &= low * q >= high * p
                some = [np.flatnonzero(apart.any(axis=axis)) for axis in (1, 0)]
                if not len(some[0]):
                    continue
                sides = []
                for pick, size, hashes in zip(some, sizes, cells[2::3]):
                    chosen = np.zeros(len(size), bool)
                    chosen[pick] = True
                    sides.append((size[pick], hashes[np.repeat(chosen, size)]))
                both = shared_counts(*sides)
                total = np.add.outer(sides[0][0], sides[1][0])
                near = (both * (p + q) >= total * p) & apart[np.ix_(*some)]
                for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
                    forest.join(int(roots[0][some[0][i]]), int(roots[1][some[1][j]]))
                if len(forest.parent) > max_nodes:
                    yield forest.edges()
                    forest = _Forest()
        yield forest.edges()

    return run


def _large_band_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between groups from all pairs of each band of ``members`` (key, node, n, root).

    A band is cut into tiles by its sets and their hashes; every two tiles meet once, in a task,
    so what is made are rows of tiles and forests of groups, not pairs.
    """
    sizes, _ = store(
        members.groupBy("key").agg(F.greatest(
            F.ceil(F.count("*") / F.lit(TILE_SETS)), F.ceil(F.sum("n") / F.lit(TILE_HASHES))
        ).cast("int").alias("blocks")),
        "band-sizes",
    )
    dealt, _ = store(
        members.join(sizes, "key")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("blocks"),
        "band-blocks",
    )
    tiles, _ = store(
        dealt.join(sets, "node").select("key", "block", "node", "root", "n", "hashes")
        .groupBy("key", "block")
        .applyInArrow(_set_tile, "key long, block int, nodes binary, roots binary, sizes binary, hashes binary"),
        "band-tiles",
    )
    sent = (
        tiles.select("key", F.col("block").alias("from"), *[F.col(c).alias(f"l_{c}") for c in ("roots", "sizes", "hashes")])
        .join(sizes, "key").withColumn("block", F.explode(F.sequence(F.col("from"), F.col("blocks") - 1)))
    )
    return sent.join(tiles, ["key", "block"]).select("l_roots", "l_sizes", "l_hashes", "roots", "sizes", "hashes").mapInArrow(
        _meet_task(), "a long, b long"
    )


def fingerprint_pairs(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) of ``nodes`` that SimHash links, a forest of each group: fingerprints that are equal or near."""
    first, _ = store(nodes.filter("n > 0").groupBy("fp").agg(F.min("node").alias("first")), "fingerprint-nodes")
    left, right = (first.select(F.col("fp").alias(x), F.col("first").alias(f"n_{x}")) for x in "ab")
    near = near_links(first.select("fp"), radius).join(left, "a").join(right, "b").select("n_a", "n_b")
    same = nodes.filter("n > 0").join(first, "fp").filter("node <> first").select("node", "first")
    return near.union(same).select(F.least("n_a", "n_b").alias("a"), F.greatest("n_a", "n_b").alias("b")).distinct()


def similar_links(
    docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, shingle: int, seed: int
) -> DataFrame:
    """(a, b): enough verified pairs to connect all of ``nodes`` that meet in a band and are similar.

    Pairs that SimHash links are tested first, and each set is held against the smallest and the
    largest one of its bands; this joins a dense group with a few rows for each member. After that only pairs of different
    groups are left, and every one of them that meets in a band is tested: by a join in a
    band of at most SMALL_BAND members, tile by tile in a larger one.
    """
    p, q = SHARE
    # an empty set is one node, so it has no other to meet
    keys = nodes.filter("n > 0").select("node", "n", F.explode("bands").alias("key"))
    one = F.struct("node", "n")
    busy = keys.groupBy("key").agg(F.min(one).alias("lo"), F.max(one).alias("hi")).filter("lo.node < hi.node")
    members, _ = store(keys.join(busy, "key"), "band-members")
    printed, _ = store(fingerprint_pairs(nodes), "fingerprint-pairs")
    chosen = members.select("node").union(printed.select("a")).union(printed.select("b")).distinct().join(nodes, "node").select("node", "at", "none", "mark")
    own = docs.select(*place(id_col, text_col), text_or_empty(F.col(text_col)).cast("binary").alias("text"))
    sets, _ = store(
        own.join(chosen, ["none", "at", "mark"]).select("node", "text")
        .mapInArrow(_set_task(shingle, seed), "node long, hashes array<long>").dropDuplicates(["node"]),
        "shingle-sets",
    )

    def near(a: Column, b: Column) -> Column:
        """Sets of too unlike sizes cannot be similar."""
        return F.least(a, b) * q >= F.greatest(a, b) * p

    ends = members.select("node", "n", F.explode(F.array("lo", "hi")).alias("end")).filter(
        (F.col("node") != F.col("end.node")) & near(F.col("n"), F.col("end.n"))
    )
    pairs = (
        ends.select(F.least("node", "end.node").alias("a"), F.greatest("node", "end.node").alias("b"))
        .unionByName(printed).distinct()
    )
    stars, _ = store(_similar(pairs, sets), "star-links")
    roots = components(stars)
    grouped = members.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    apart, _ = store(
        grouped.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("m"))
        .filter("r0 < r1").select("key", "m"),
        "apart",
    )
    open_, _ = store(grouped.join(apart, "key"), "open-bands")
    large = _large_band_links(open_.filter(F.col("m") > SMALL_BAND).drop("m"), sets)
    small = open_.filter(F.col("m") <= SMALL_BAND)
    x, y = small.alias("x"), small.alias("y")
    rest = (
        x.join(
            y,
            (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root"))
            & (F.col("x.node") < F.col("y.node")) & near(F.col("x.n"), F.col("y.n")),
        )
        .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
        .join(pairs, ["a", "b"], "left_anti")
    )
    return stars.unionByName(large).unionByName(_similar(rest, sets))


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED
) -> DataFrame:
    """``docs`` with one row of each group of near copies: the smallest id, then the smallest text hash.

    Texts are lower-cased (A-Z) and cut into words; a text shorter than a shingle is one shingle,
    and texts without words (or null) are copies of each other. Two rows are linked when the sets
    of their shingles have a Jaccard similarity of 0.8 or more, and groups are what links connect.
    Rows with a null id take part and come last. All columns stay; an empty table gives an empty table.
    """
    rows = docs.select(*place(id_col, text_col), text_or_empty(F.col(text_col)).cast("binary").alias("text"))
    prints, _ = store(
        rows.select(F.struct("none", "at").alias("doc"), "mark", "text")
        .mapInArrow(_print_task(shingle, seed), "doc struct<none:boolean,at:bigint>, mark long, node long, n long, bands array<long>, fp long")
        .select("doc.none", "doc.at", "mark", "node", "n", "bands", "fp"),
        "shingle-prints",
    )
    nodes, _ = store(
        prints.groupBy("node", "n").agg(
            F.min(F.struct("none", "at", "mark")).alias("p"), F.any_value("bands").alias("bands"),
            F.any_value("fp").alias("fp"),
        ).select("node", "n", "p.*", "bands", "fp"),
        "shingle-nodes",
    )
    roots, _ = store(components(similar_links(docs, nodes, id_col, text_col, shingle, seed)), "near-roots")
    members = prints.join(roots, "node", "left").select(
        "none", "at", "mark", F.coalesce("root", "node").alias("class")
    )
    return keep_first(docs, members, id_col, text_col)
