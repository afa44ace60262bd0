"""Spelling variants: words one edit apart, found through a trie of letter-group counts.

A word is filed by how often each letter group occurs in it. One inserted, deleted or replaced
letter raises at most one count by one and lowers at most one other by one, so a search down
the trie spends a surplus and a deficit of one each; the words it reaches are verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgatlas.llm.common import store, text_or_empty

LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A form is this many times as frequent.
TIMES = 10
EDIT_MODULUS = 31
#: Letter groups in the order of the trie's levels; every other letter falls into one of the rest.
GROUPS = "e n t a i o h r s u l c d f g b m z w y q x v p k j".split()
OTHER_GROUPS = 8
#: Words in one block of a subtree.
BLOCK_WORDS = 4096
#: Longer words are compared one by one rather than in a matrix.
MATRIX_LETTERS = 64
#: Counts above this are filed alike, which only adds words to verify.
MOST_COUNT = 62
_FRONTIER = 1 << 17
#: Partial counts that a task holds before it passes them on.
_HELD_WORDS = 200_000
_RUN = re.compile("[A-Za-zÀ-ÿ]+")


def count_runs(doc: str, text: bytes, modulus: int, least: int) -> Counter:
    """How often each word occurs in one text, after the contract's deletions."""
    out: Counter = Counter()
    start = zlib.crc32(f"{doc}:".encode())
    for run, n in Counter(_RUN.findall(text.lower().decode())).items():  # of bytes: A-Z only
        if len(run) < least:
            continue
        h = zlib.crc32(run.encode(), start)
        if h % modulus == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least:
                continue
        out[run] += n
    return out


def _count_task(modulus: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"]
            )

        held: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, n in count_runs(doc, text.as_py(), modulus, least).items():
                    held[word] += n
                if len(held) > _HELD_WORDS:
                    yield out()
                    held = Counter()
        yield out()

    return run


def vocabulary(
    docs: DataFrame, id_col: str, text_col: str, modulus: int = EDIT_MODULUS,
    least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
) -> DataFrame:
    """(word, n) over all texts; counts are combined in the tasks before they are shuffled."""
    partial = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"),
        text_or_empty(F.col(text_col)).cast("binary").alias("text"),
    ).mapInArrow(_count_task(modulus, least_length), "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


_GROUP_OF = np.array([
    GROUPS.index(chr(c)) if chr(c) in GROUPS else len(GROUPS) + c % OTHER_GROUPS for c in range(256)
], np.uint8)
LEVELS = len(GROUPS) + OTHER_GROUPS


def _group_count(word: Column, level: int) -> Column:
    """How often the letter of one of the first levels occurs, MOST_COUNT at most."""
    return F.least(F.length(word) - F.length(F.translate(word, GROUPS[level], "")), F.lit(MOST_COUNT))


class Block:
    """Words of one block as a trie: rows sorted by counts, nodes of each level as ranges of rows."""

    def __init__(self, words: bytes, first: int) -> None:
        letters = np.frombuffer(words, np.uint8)
        ends = np.flatnonzero(letters == 10)
        starts = np.concatenate([[0], ends[:-1] + 1])
        self.lengths = ends - starts
        n = len(ends)
        row = np.repeat(np.arange(n), self.lengths)
        inside = letters != 10
        counts = np.bincount(row * LEVELS + _GROUP_OF[letters[inside]], minlength=n * LEVELS).reshape(n, LEVELS)
        counts = np.minimum(counts, MOST_COUNT).astype(np.uint8)
        self.order = np.lexsort(counts.T[::-1])
        counts = np.ascontiguousarray(counts[self.order])
        self.starts, self.lengths, self.letters = starts[self.order], self.lengths[self.order], letters
        # new[d]: rows at which a node of level d begins
        differs = np.ones((n, LEVELS + 1), bool)
        differs[1:, 0] = False
        differs[1:, 1:] = np.logical_or.accumulate(counts[1:] != counts[:-1], axis=1)
        self.first = first
        self.nodes = [np.flatnonzero(differs[:, d]) for d in range(first, LEVELS + 1)]
        # children of node k of a level: child[k] to child[k + 1] of the next one, each with a count
        self.child = [
            np.append(np.searchsorted(b, a), len(b)) for a, b in zip(self.nodes, self.nodes[1:])
        ]
        self.count = [counts[b, d].astype(np.int16) for d, b in zip(range(first, LEVELS), self.nodes[1:])]
        self.leaf_end = np.append(self.nodes[-1][1:], n)

    def matrix(self) -> np.ndarray:
        width = int(min(self.lengths.max(initial=0), MATRIX_LETTERS)) + 1
        out = np.zeros((len(self.starts), width), np.uint8)
        place = np.arange(width)[None, :]
        held = place < np.minimum(self.lengths, MATRIX_LETTERS)[:, None]
        out[held] = self.letters[(self.starts[:, None] + place)[held]]
        return out

    @cached_property
    def rank(self) -> np.ndarray:
        """Places of the rows among all words of the block."""
        words = [self.word(r) for r in range(len(self.starts))]
        out = np.empty(len(words), np.int64)
        out[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        return out

    def word(self, row: int) -> bytes:
        return self.letters[self.starts[row] : self.starts[row] + self.lengths[row]].tobytes()


def _spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place its number ``sizes`` times, and 0, 1, ... within it."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def candidates(left: Block, right: Block, surplus: int, deficit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of leaves (rows of ``left``, rows of ``right``) within the budget, depth first.

    The stack holds batches of node pairs of one level with what they have left to spend; a batch
    that grows is cut, so memory is bounded by the depth times a batch.
    """
    start = np.zeros(1, np.int64)
    stack = [(0, start, start, np.array([surplus], np.int8), np.array([deficit], np.int8))]
    last = len(left.child)
    while stack:
        level, u, v, more, less = stack.pop()
        if level == last:
            lo, hi = left.nodes[-1][u], left.leaf_end[u]
            owner, at = _spread(hi - lo)
            rows, u2 = lo[owner] + at, v[owner]
            for cut in range(0, len(rows), _FRONTIER):
                some = slice(cut, cut + _FRONTIER)
                lo, hi = right.nodes[-1][u2[some]], right.leaf_end[u2[some]]
                for part in _portions(hi - lo):
                    owner, at = _spread((hi - lo)[part])
                    yield rows[some][part][owner], lo[part][owner] + at
            continue
        a, b = left.child[level], right.child[level]
        sizes = (a[u + 1] - a[u]) * (b[v + 1] - b[v])
        for part in _portions(sizes):
            owner, at = _spread(sizes[part])
            pu, pv = u[part][owner], v[part][owner]
            wide = b[pv + 1] - b[pv]
            cu, cv = a[pu] + at // wide, b[pv] + at % wide
            d = right.count[level][cv] - left.count[level][cu]
            m, s = more[part][owner], less[part][owner]
            fits = (d == 0) | ((d == 1) & (m > 0)) | ((d == -1) & (s > 0))
            d = d[fits]
            stack.append((level + 1, cu[fits], cv[fits], m[fits] - (d == 1), s[fits] - (d == -1)))
            if not len(d):
                stack.pop()


def _portions(sizes: np.ndarray) -> list[slice]:
    """Cuts after which each part gives about _FRONTIER rows, a single place may give more."""
    if sizes.sum() <= _FRONTIER:
        return [slice(0, len(sizes))]
    number = np.cumsum(sizes) // _FRONTIER
    edges = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [len(sizes)]])
    return [slice(a, b) for a, b in zip(edges.tolist(), edges[1:].tolist())]


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether one inserted, deleted or replaced letter makes ``b`` of ``a``."""
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    if len(a) == len(b):
        return at < len(a) and a[at + 1 :] == b[at + 1 :]
    return len(a) + 1 == len(b) and a[at:] == b[at + 1 :]


class _Verifier:
    """Exact test of candidate pairs, by rows of letters filled up with zeros."""

    def __init__(self, left: Block, right: Block) -> None:
        self.left, self.right = left, right
        a, b = left.matrix(), right.matrix()
        width = max(a.shape[1], b.shape[1])
        self.a, self.b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        la, lb = self.left.lengths[i], self.right.lengths[j]
        gap = lb - la
        out = np.zeros(len(i), bool)
        wide = np.maximum(la, lb) > MATRIX_LETTERS
        for k in np.flatnonzero(wide & (np.abs(gap) <= 1)):
            out[k] = one_edit(self.left.word(i[k]), self.right.word(j[k]))
        same = np.flatnonzero((gap == 0) & ~wide)
        out[same] = (self.a[i[same]] != self.b[j[same]]).sum(axis=1) == 1
        for sign, short, long, s, t in ((1, self.a, self.b, i, j), (-1, self.b, self.a, j, i)):
            some = np.flatnonzero((gap == sign) & ~wide)
            if len(some):
                x, y = short[s[some]], long[t[some]]
                straight, moved = x != y, x[:, :-1] != y[:, 1:]
                # the first letter that differs, and the last one that differs when moved by one
                first = straight.argmax(axis=1)
                back = np.where(moved.any(axis=1), moved.shape[1] - 1 - moved[:, ::-1].argmax(axis=1), -1)
                out[some] = back < first
        return out


_NEAR = "word string, n_near long, best struct<down:bigint,word:string>"


def _near_rows(a: Block, b: Block, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """For each word of ``a`` in the pairs (i, j): how many it meets, and the best one (largest n, then name)."""
    order = np.lexsort((b.rank[j], -n, i))
    words, total = np.unique(i, return_counts=True)
    best = order[np.cumsum(total) - total]
    names = [[x.word(r).decode("latin-1") for r in rows.tolist()] for x, rows in ((a, words), (b, j[best]))]
    return pa.RecordBatch.from_arrays([
        pa.array(names[0], pa.string()), pa.array(total),
        pa.StructArray.from_arrays([pa.array(-n[best]), pa.array(names[1], pa.string())], ["down", "word"]),
    ], ["word", "n_near", "best"])


@lru_cache(maxsize=4)  # pairs of blocks come sorted by one side
def _block_of(words: bytes, first: int) -> Block:
    return Block(words, first)


def _meet_task(first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                lw, ln, rw, rn, surplus, deficit, same = (batch.column(c)[row].as_py() for c in range(7))
                left, right = _block_of(lw, first), _block_of(rw, first)
                n_left, n_right = (np.frombuffer(x, np.int64)[b.order] for x, b in ((ln, left), (rn, right)))
                verify, pairs = _Verifier(left, right), [(np.empty(0, np.int64),) * 2]
                for i, j in candidates(left, right, surplus, deficit):
                    if same:
                        i, j = i[i < j], j[i < j]
                    good = verify(i, j)
                    pairs.append((i[good], j[good]))
                i, j = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
                if len(i):
                    yield _near_rows(left, right, i, j, n_right[j])
                    yield _near_rows(right, left, j, i, n_left[i])

    return run


def _offsets(levels: int) -> list[tuple[int, int, int]]:
    """Changes of a subtree's key that one edit can make, one of each pair of opposites:
    (change, surplus left, deficit left)."""
    unit = [64 ** (levels - 1 - d) for d in range(levels)]
    out = [(0, 1, 1)]
    for d in range(levels):
        out.append((unit[d], 0, 1))
        out += [(unit[d] - unit[e], 0, 0) for e in range(d + 1, levels)]
    return out


def _block_task(_key_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block's words and counts as bytes; at most about BLOCK_WORDS words."""
    table = pa.Table.from_batches(list(batches))
    words = table.column("word").to_pylist()
    yield pa.RecordBatch.from_arrays([
        pa.array([table.column("key")[0].as_py()], pa.int64()), pa.array([table.column("block")[0].as_py()], pa.int32()),
        pa.array(["".join(w + "\n" for w in words).encode("latin-1")], pa.binary()),
        pa.array([table.column("n").to_numpy().astype(np.int64).tobytes()], pa.binary()),
    ], ["key", "block", "words", "counts"])


def near_words(words: DataFrame, block_words: int = BLOCK_WORDS, depth: int | None = None) -> DataFrame:
    """(word, n_near, best (minus its n, word)) of every word of ``words`` (word, n) that has a near one.

    The first ``depth`` levels of the trie are dealt over tasks: each subtree is a key, a full one
    is cut into blocks, and each block meets those of the subtrees that one edit can reach, each
    pair of blocks once. Below that a task searches both tries depth first. What leaves a task is
    one row per word and pair of blocks at most.
    """
    n = words.count()
    if depth is None:
        depth = 2
        while depth < 9 and 5**depth * block_words < n:
            depth += 1
    key = F.lit(0).cast("long")
    for level in range(depth):
        key = key * 64 + _group_count(F.col("word"), level)
    keyed = words.select("word", "n", key.alias("key"))
    # letters per block are bounded as well, for very long words
    sizes, _ = store(
        keyed.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.length("word")).alias("letters")).select(
            "key", F.greatest(F.ceil(F.col("n") / block_words), F.ceil(F.col("letters") / (block_words * 64))).cast("int").alias("blocks")
        ),
        "subtree-sizes",
    )
    blocks, _ = store(
        keyed.join(sizes, "key")
        .select("word", "n", "key", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int").alias("block"))
        .groupBy("key", "block").applyInArrow(_block_task, "key long, block int, words binary, counts binary"),
        "blocks",
    )
    offsets = F.array(*[
        F.struct(F.lit(o).cast("long").alias("o"), F.lit(s).alias("surplus"), F.lit(t).alias("deficit"))
        for o, s, t in _offsets(depth)
    ])
    sent = blocks.select(
        F.col("words").alias("lw"), F.col("counts").alias("ln"), F.col("block").alias("lb"), F.col("key").alias("lk"),
        F.inline(offsets),
    )
    met = (
        sent.withColumn("key", F.col("lk") + F.col("o")).join(sizes, "key")
        .withColumn("block", F.explode(F.sequence(
            F.when(F.col("o") == 0, F.col("lb")).otherwise(F.lit(0)), F.col("blocks") - 1
        )))
        .join(blocks, ["key", "block"])
        .select("lw", "ln", F.col("words").alias("rw"), F.col("counts").alias("rn"), "surplus", "deficit",
                ((F.col("o") == 0) & (F.col("lb") == F.col("block"))).alias("same"))
    )
    partial = met.mapInArrow(_meet_task(depth), _NEAR)
    return partial.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: the last word of its chain.

    Each form is several times as frequent, so a chain is at most 19 long; every round doubles
    the steps that a row has gone.
    """
    now, _ = store(forms.select("word", F.col("form").alias("root")), "chains")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now, _ = store(
            now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            "chains",
        )
        if not now.filter("moved").take(1):
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    modulus: int = EDIT_MODULUS,
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    times: int = TIMES,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Per word of all texts: word, form, root, n, n_near, form_n.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, of ``least_length`` letters
    and ``least_count`` occurrences or more. Where ``modulus`` divides the CRC-32 of
    ``<id>:<run>``, one letter is left out first, as a stand-in for misspellings. Near words are
    one edit apart; the form is the near word of the largest count (ties: the smallest) if it
    is ``times`` times as frequent, the root the end of the chain of forms.

    A null text has no words; a null id counts as an empty one. Rows with the same id, and
    repeated rows, count each. Further columns are ignored; an empty table gives an empty table.
    """
    if times < 2:
        raise ValueError("a form must be at least twice as frequent")
    words, _ = store(vocabulary(docs, id_col, text_col, modulus, least_length, least_count), "words")
    near, _ = store(near_words(words, block_words), "near-words")
    judged = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(-F.col("best.down") >= F.col("n") * times, F.col("best")).alias("best"),
    ).select("word", "n", "n_near", F.col("best.word").alias("form"), (-F.col("best.down")).alias("form_n"))
    judged, _ = store(judged, "forms")
    return judged.join(_roots(judged.filter("form IS NOT NULL")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
