"""Match new questions to known ones: exact key first, then most shared words.

A question that finds its key needs no words, so only the others are held against known
questions, as word hashes, block by block. First all are held against the known questions with
most words: what they share there is a bound that the best known question must reach. Then a
pair of blocks counts shared words through the lists of texts that hold a word. A question's most
frequent words are left out of this, as many as the bound allows if two other words are
still to be shared; they are looked up only for the texts that share enough of the
others. Only the best known question of a block leaves a task, so neither long texts nor frequent
words make rows. Blocks are cut by texts and by words.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pkgatlas import fixed
from pkgatlas.functions.text import query_part, significant_words
from pkgatlas.session import materialize

#: New texts, and known ones, in a block; fewer known ones are cut into up to SPREAD blocks.
NEW_BLOCK, BLOCK = 65_536, 65_536
SPREAD, LEAST_BLOCK = 12, 512
#: Words in a block: it is one row of at most about 64 MB.
BLOCK_WORDS = 1 << 22
#: Known texts, those with most words, that give the bounds: one in LEAD_SHARE, at most LEAD, and at
#: most a block's words; fewer than LEAST_BLOCK are not worth a pass. A part of them gives the
#: bounds for a larger part.
LEAD, LEAD_SHARE, LEAD_PARTS = 16_384, 32, (64, 8, 1)
#: New texts, and list entries, that are counted at once.
SLICE, HITS = 8_192, 1 << 18
#: Words that more than one text in so many holds may be left out of the lists, at most so
#: many of them; which texts hold them is kept as a row.
DENSE_SHARE, DENSE_WORDS = 128, 1024
#: Words that must be met in the lists before the rows are looked at.
WITNESSES = 2


_BLOCK = "block int, no binary, own binary, words binary, counts binary, links binary"
_TYPES = {"no": np.int64, "own": np.int64, "words": np.int64, "counts": np.int32, "links": np.int32, "least": np.int64}


def _keyed(df: DataFrame, max_chars: int | None) -> DataFrame:
    return df.select("query_id", "mode", query_part(F.col("query"), max_chars).alias("key"))


def _hashes(stop_words: Sequence[str]) -> Column:
    """The key's significant words as numbers that differ between modes."""
    words = significant_words(F.replace("key", F.lit("_"), F.lit(" ")), stop_words)
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64("mode", w))


def _pack(by_word: bool) -> Callable:
    """One block as bytes: its texts' numbers in order, its words, and which text holds which word.

    By text, ``counts`` are words of a text and ``links`` places of words; by word, ``counts``
    are texts of a word and ``links`` places of texts.
    """

    def run(_key: tuple, table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("no").to_numpy())))
        lists = table.column("hashes").combine_chunks()
        counts = lists.value_lengths().to_numpy(zero_copy_only=False)
        words, links = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        if by_word:
            holder = np.repeat(np.arange(len(counts)), counts)
            counts, links = np.bincount(links, minlength=len(words)), holder[np.argsort(links, kind="stable")]
        columns = {
            "no": table.column("no").to_numpy(), "own": table.column("own").to_numpy(),
            "words": words, "counts": counts, "links": links,
        }
        return pa.table({
            "block": pa.array([table.column("block")[0].as_py()], pa.int32()),
            **{k: pa.array([np.ascontiguousarray(v, _TYPES[k]).tobytes()], pa.binary()) for k, v in columns.items()},
        })

    return run


def _packed(sets: DataFrame, blocks: int, by_word: bool) -> DataFrame:
    return sets.select(
        F.pmod(F.xxhash64("no"), F.lit(blocks)).cast("int").alias("block"), "no",
        F.coalesce("own", F.lit(-1)).cast("long").alias("own"), "hashes",
    ).groupBy("block").applyInArrow(_pack(by_word), _BLOCK)


def _unpacked(table: pa.Table) -> dict[str, np.ndarray]:
    return {k: np.frombuffer(table.column(k)[0].as_py(), t) for k, t in _TYPES.items() if k in table.column_names}


def _cells(owner: np.ndarray, begin: np.ndarray, count: np.ndarray, links: np.ndarray, n: int) -> np.ndarray:
    """``owner * n + text`` for every text in the lists, in order; a pair comes once a shared word."""
    shift = np.repeat(begin - (count.cumsum() - count), count)
    cells = np.repeat((owner * n).astype(np.int32), count)
    cells += links[shift + np.arange(len(shift))]
    cells.sort()
    return cells


def _best(new: dict, known: dict, least: np.ndarray, share: int, most: int) -> tuple[np.ndarray, ...]:
    """New texts that share at least ``least`` (2 or more) words with a known one, its place, the number.

    The known text that shares most is taken, among equals the first.
    """
    n, words, links = len(known["no"]), known["words"], known["links"]
    lengths = known["counts"].astype(np.int64)
    starts = lengths.cumsum() - lengths
    at = np.minimum(np.searchsorted(words, new["words"]), len(words) - 1)
    place = np.where(words[at] == new["words"], at, -1)
    own = np.minimum(np.searchsorted(known["no"], new["own"]), n - 1)
    own = np.where(known["no"][own] == new["own"], own, -1)
    # the most frequent words: a row each, which texts hold them; the row after them is held by all
    dense = np.flatnonzero(lengths * share > n)
    dense = dense[np.argsort(-lengths[dense], kind="stable")[:most]]
    row = np.full(len(words), -1)
    row[dense] = np.arange(len(dense))
    held = np.zeros((len(dense) + 1, n), bool)
    for c, w in enumerate(dense.tolist()):
        held[c, links[starts[w] : starts[w] + lengths[w]]] = True
    held[-1] = True
    held = held.ravel()
    ends = new["counts"].astype(np.int64).cumsum()
    out = []
    for a in range(0, len(least), SLICE):
        need = least[a : a + SLICE]
        size = len(need)
        at = place[new["links"][ends[a] - new["counts"][a] : ends[a + size - 1]]]
        owner = np.repeat(np.arange(size), new["counts"][a : a + size])
        owner, at = owner[at >= 0], at[at >= 0]
        some = (np.bincount(owner, minlength=size) >= need)[owner]
        owner, at = owner[some], at[some]
        # each text's most frequent words are left out, if two others must be shared all the same
        frequent = np.flatnonzero(row[at] >= 0)
        frequent = frequent[np.argsort(owner[frequent] * len(dense) + row[at[frequent]])]
        whose = owner[frequent]
        nth = np.arange(len(whose)) - np.searchsorted(whose, whose)
        some = nth < need[whose] - WITNESSES
        frequent, whose, nth = frequent[some], whose[some], nth[some]
        left_out = np.bincount(whose, minlength=size)
        late = np.full((size, left_out.max()), len(dense))
        late[whose, left_out[whose] - 1 - nth] = row[at[frequent]]  # the rarest first
        owner, at = np.delete(owner, frequent), np.delete(at, frequent)
        first = np.searchsorted(owner, np.arange(size + 1))
        hits = np.bincount(owner, lengths[at], size).cumsum()
        x = 0
        while x < size:
            done = hits[x - 1] if x else 0
            y = max(x + 1, min(int(np.searchsorted(hits, done + HITS, "right")), x + (2**31 - 1) // n))
            some = slice(first[x], first[y])
            cells = _cells(owner[some] - x, starts[at[some]], lengths[at[some]], links, n)
            edges = np.diff((cells[1:] == cells[:-1]).astype(np.int8), prepend=0, append=0)
            begin = np.flatnonzero(edges == 1)
            q, text = np.divmod(cells[begin], n)
            q += x
            # how many of the words left out a text may lack
            spare = np.flatnonzero(edges == -1) - begin + 1 + (left_out - need)[q]
            some = np.flatnonzero((spare >= 0) & (text != own[a + q]))
            q, text, spare = q[some], text[some], spare[some]
            for j in range(left_out[x:y].max()):
                spare -= ~held[late[q, j] * n + text]
                some = np.flatnonzero(spare >= 0)
                q, text, spare = q[some], text[some], spare[some]
            shared = need[q] + spare
            if len(q):
                begin = np.flatnonzero(np.diff(q, prepend=-1))
                top = np.maximum.reduceat(shared * n + (n - 1 - text), begin)
                out.append((a + q[begin], n - 1 - top % n, top // n))
            x = y
    return tuple(np.concatenate([o[i] for o in out]) if out else np.empty(0, np.int64) for i in range(3))


def _some_of(known: dict, n: int) -> dict:
    """The first ``n`` texts of a block."""
    some = known["links"] < n
    word = np.repeat(np.arange(len(known["words"])), known["counts"])[some]
    counts = np.bincount(word, minlength=len(known["words"]))
    return {**known, "no": known["no"][:n], "counts": counts, "links": known["links"][some]}


def _bound(min_shared: int) -> Callable:
    """A new block with the number of words that each text shares with one of the known block."""
    share, most, parts = DENSE_SHARE, DENSE_WORDS, LEAD_PARTS
    names = [f.split()[0] for f in _BLOCK.split(", ")]

    def run(_key: tuple, new: pa.Table, known: pa.Table) -> pa.Table:
        if not new.num_rows:
            return new.select(names).append_column("least", pa.array([], pa.binary()))
        asked = _unpacked(new)
        least = np.full(len(asked["no"]), min_shared)
        if known.num_rows:
            told = _unpacked(known)
            for part in parts:
                block = _some_of(told, -(-len(told["no"]) // part))
                q, _, shared = _best(asked, block, least, share, most)
                least[q] = shared
        return new.select(names).append_column("least", pa.array([least.tobytes()], pa.binary()))

    return run


def _count(min_shared: int) -> Callable:
    """For each new text of a block its best text in a known block, the first among equals."""
    share, most = DENSE_SHARE, DENSE_WORDS

    def run(_key: tuple, new: pa.Table, known: pa.Table) -> pa.Table:
        columns = [np.empty(0, np.int64)] * 3
        if new.num_rows and known.num_rows:
            asked, told = _unpacked(new), _unpacked(known)
            least = asked["least"] if "least" in asked else np.full(len(asked["no"]), min_shared)
            q, text, shared = _best(asked, told, least, share, most)
            columns = [asked["no"][q], told["no"][text], shared]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["new_no", "known_no", "shared"])

    return run


def match_queries(
    new: DataFrame,
    known: DataFrame,
    min_words: int = fixed.MATCH_MIN_WORDS,
    min_shared: int = fixed.MATCH_MIN_SHARED,
    stop_words: Sequence[str] = fixed.STOP_WORDS,
    max_chars: int | None = None,
    exclude_self: bool = False,
) -> DataFrame:
    """Best known question for every new one (both ``query_id, query, mode``).

    ``match`` is ``exact``, ``fuzzy`` or null. Ties go to the smaller known key. Words come
    from the whole question, or from its key of ``max_chars``. ``exclude_self``: a known row
    with the new row's own query_id is not looked at.
    """
    if min_shared < 2:
        raise ValueError("min_shared must be at least 2")
    told = materialize(_keyed(known, max_chars), "known")
    # numbers in the order of the keys, so the smallest number is the smallest key
    stored = materialize(
        told.groupBy("mode", "key").agg(F.min("query_id").alias("known_id")).orderBy("key")
        .select("mode", "key", "known_id", F.monotonically_increasing_id().alias("no"), _hashes(stop_words).alias("hashes")),
        "known-keys",
    )
    exact = stored.select("mode", "key", F.col("known_id").alias("exact_id"), F.col("no").alias("own"))
    if exclude_self:
        second = (
            told.select("mode", "key", "query_id").join(exact, ["mode", "key"])
            .filter(F.col("query_id") > F.col("exact_id"))
            .groupBy("mode", "key").agg(F.min("query_id").alias("second_id"))
        )
        exact = exact.join(second, ["mode", "key"], "left")
        exact_id = F.when(F.col("exact_id") == F.col("query_id"), F.col("second_id")).otherwise(F.col("exact_id"))
    else:
        exact_id = F.col("exact_id")
    asked = materialize(
        _keyed(new, max_chars).join(exact, ["mode", "key"], "left")
        .select("query_id", "mode", "key", "own", exact_id.alias("exact_id")),
        "asked",
    )

    known_sets = stored.filter(F.size("hashes") >= min_shared).select("mode", "no", F.lit(-1).alias("own"), "hashes")
    new_sets = materialize(
        asked.filter(F.col("exact_id").isNull()).select("mode", "key", "own").distinct()
        .withColumn("hashes", _hashes(stop_words))
        .filter(F.size("hashes") >= max(min_words, min_shared))
        .withColumn("no", F.monotonically_increasing_id()),
        "new-keys",
    )

    def volume(sets: DataFrame) -> list[int]:
        size = F.size("hashes")
        return [v or 0 for v in sets.agg(F.count("*"), F.sum(size), F.max(size), F.countDistinct("mode")).first()]

    (asked_n, asked_words, *_), (n, known_words, longest, modes) = volume(new_sets), volume(known_sets)
    new_blocks = max(-(-asked_n // NEW_BLOCK), -(-asked_words // BLOCK_WORDS), 1)
    known_blocks = max(-(-n // BLOCK), -(-known_words // BLOCK_WORDS), min(SPREAD, -(-n // LEAST_BLOCK)), 1)
    # a block is one row; it is sent once for each block of the other side
    left = _packed(new_sets, new_blocks, False)

    def each(blocks: DataFrame, count: int) -> DataFrame:
        return blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))

    lead_n = min(LEAD, n // LEAD_SHARE, BLOCK_WORDS // max(longest, 1))
    if n // LEAD_SHARE >= LEAST_BLOCK and lead_n >= modes > 0:
        by_size = Window.partitionBy("mode").orderBy(F.size("hashes").desc(), "no")
        lead = known_sets.withColumn("place", F.row_number().over(by_size)).filter(F.col("place") <= lead_n // modes)
        left = left.groupBy("block").cogroup(
            each(_packed(lead, 1, True), new_blocks).groupBy("other")
        ).applyInArrow(_bound(min_shared), _BLOCK + ", least binary")
    right = each(_packed(known_sets, known_blocks, True), new_blocks)
    hits = (
        each(left, known_blocks).groupBy(F.col("block").alias("a"), F.col("other").alias("b"))
        .cogroup(right.groupBy(F.col("other").alias("a"), F.col("block").alias("b")))
        .applyInArrow(_count(min_shared), "new_no long, known_no long, shared long")
    )
    best = (
        hits.groupBy("new_no").agg(F.max(F.struct("shared", (-F.col("known_no")).alias("neg"))).alias("m"))
        .select("new_no", "m.shared", (-F.col("m.neg")).alias("known_no"))
        .join(stored.select(F.col("no").alias("known_no"), F.col("known_id").alias("fuzzy_id")), "known_no")
        .join(new_sets.select(F.col("no").alias("new_no"), "mode", "key"), "new_no")
        .select("mode", "key", "fuzzy_id", "shared")
    )
    return asked.join(best, ["mode", "key"], "left").select(
        "query_id",
        F.coalesce("exact_id", "fuzzy_id").alias("known_id"),
        F.when(F.col("exact_id").isNotNull(), "exact")
        .when(F.col("fuzzy_id").isNotNull(), "fuzzy")
        .alias("match"),
        F.when(F.col("exact_id").isNull(), F.col("shared")).alias("shared_words"),
    )
