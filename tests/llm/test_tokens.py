import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from helpers import frame, rows
from pkgatlas.llm import packing, rans, token_files, tokens
from pkgatlas.session import new_work_path
from tokenizers import Tokenizer

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "a", "B", " ", "  ", "\n", "\t", "\r", "\x1c", "\x85", " ", "é", "é", "'s", "'", "1", "23", "!!", "ß", "Σ", "ς", "İ",
    "漢", "　", "​", "﻿", "<|endoftext|>", "<", "|", "\x00", "\x0b", "\U0001f600", "ſ", "K", "mañana", "Über", "÷", ".", ",", "x.",
]


@pytest.mark.parametrize("make,path", [(tokens.byte_level_encoder, BYTE), (tokens.word_encoder, WORD)])
def test_pieces_give_the_library_s_ids(make, path):
    rnd = random.Random(7)
    encoder, plain = make(path, 2), Tokenizer.from_file(path)
    texts = ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 10))) for _ in range(3000)] + [r[1] or "" for r in rows()]
    whole = pa.array([t.encode() for t in texts], pa.binary())
    for text, alone, ids, want in zip(
        texts, map(encoder, (whole.slice(k, 1) for k in range(len(whole)))), encoder(whole), plain.encode_batch(texts, add_special_tokens=False),
        strict=True,
    ):
        assert ids.tolist() == next(alone).tolist() == want.ids + [2], repr(text)


def test_chunks_and_slices_give_the_same(monkeypatch):
    """Texts are cut in chunks; a long text is one of its own, and empty ones stand anywhere."""
    texts = ["", "one, two.", "x" * 500, "", "a b", "", "Ñandú, ciÓn. ×. ÷, 3.", ""]
    whole = pa.array([t.encode() for t in texts], pa.binary())
    for make, path in ((tokens.byte_level_encoder, BYTE), (tokens.word_encoder, WORD)):
        want = [e.ids + [5] for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
        for size in (1, 12, 1 << 20):
            monkeypatch.setattr(tokens, "CHUNK_BYTES", size)
            encoder = make.__wrapped__(path, 5)
            assert [x.tolist() for x in encoder(whole)] == want
            assert [x.tolist() for x in encoder(whole.slice(3, 4))] == want[3:7]
            assert list(encoder(whole.slice(2, 0))) == []


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 50)
    encoder = tokens.byte_level_encoder.__wrapped__(BYTE, 0)
    plain = Tokenizer.from_file(BYTE)
    for i in range(40):
        text = " ".join(f"word{chr(97 + (i * j) % 26)}{j % 5}" for j in range(30)) + " " + "x" * 200
        (ids,) = encoder(pa.array([text.encode()], pa.binary()))
        assert ids.tolist()[:-1] == plain.encode(text, add_special_tokens=False).ids
        assert len(encoder.cache) <= 50


@pytest.mark.parametrize("n,kinds", [(0, 1), (1, 1), (5, 1), (2047, 40), (2048, 40), (2049, 3000), (600_000, 50_257)])
def test_range_coder_round_trip(n, kinds):
    ids = (np.random.default_rng(n).zipf(1.3, n) % kinds).astype("<u4") + np.uint32(7)
    data = rans.encode(ids)
    segment = rans.Segment(data)
    assert (segment.ids() == ids).all()
    if n > 500_000:
        counts = np.unique(ids, return_counts=True)[1] / n
        entropy = -(counts * np.log2(counts)).sum()
        assert len(data) * 8 / n < 1.25 * entropy
        assert (segment.block(1) == ids[rans.BLOCK_IDS :]).all()  # alone, by its checkpoint
        for place in (len(data) - 9, len(data) // 2, len(data) - 4 * rans.LANES):
            spoiled = bytearray(data)
            spoiled[place] ^= 4
            with pytest.raises(ValueError):
                rans.Segment(bytes(spoiled)).ids()


@pytest.mark.parametrize("lengths,want", [
    ([], []), ([3], [3]), ([3, 7], [10]), ([3, 8, 2], [11, 13]), ([25], [10, 20, 25]), ([4, 25, 1], [4, 14, 24, 29, 30]), ([10, 20, 5], [10, 20, 30, 35]),
])
def test_blocks_hold_whole_documents(lengths, want):
    assert rans.block_ends(lengths, 10) == want
    ids = np.random.default_rng(1).integers(0, 9, sum(lengths)).astype("<u4")
    segment = rans.Segment(rans.encode(ids, want))
    assert (segment.ids() == ids).all() and len(segment.points) == len(want)
    for begin in range(len(want)):
        for end in range(begin + 1, len(want) + 1):
            alone = rans.Segment(segment.cut(begin, end))
            assert (alone.ids() == ids[([0, *want])[begin] : want[end - 1]]).all()


def test_large_ids_and_wrong_magic():
    ids = np.array([2**32 - 1, 5, 2**31, 5], "<u4")
    assert (rans.Segment(rans.encode(ids)).ids() == ids).all()
    with pytest.raises(ValueError):
        rans.Segment(b"x" * 40)


def reference(path, end, data):
    plain = Tokenizer.from_file(path)
    return [np.array(e.ids + [end], "<u4") for e in plain.encode_batch([r[1] or "" for r in data], add_special_tokens=False)]


@pytest.mark.parametrize("block_ids", [rans.BLOCK_IDS, 300])
def test_token_files_round_trip(spark, docs, no_docs, block_ids):
    path = new_work_path(spark, "test-tokens")
    token_files.write_token_files(docs, path, tokens.byte_level_encoder, BYTE, 0, segment_ids=20_000, block_ids=block_ids)
    got = [tuple(r) for r in token_files.read_token_files(spark, path).collect()]
    want = defaultdict(list)
    for r, ids in zip(rows(), reference(BYTE, 0, rows())):
        want[r[0]].append(ids.tobytes())
    at, order = 0, sorted(got, key=lambda r: r[1])
    assert [r[0] for r in order] == sorted((r[0] for r in rows()), key=lambda d: (d is not None, d or 0))
    for doc, start, n, ids in order:
        assert start == at and n * 4 == len(ids)
        want[doc].remove(bytes(ids))
        at += n
    for r in spark.read.parquet(path).collect():
        ends = np.cumsum(rans.Segment(bytes(r["data"])).points["ids"]).tolist()
        assert ends == rans.block_ends(r["n_tokens"], block_ids)
    path = new_work_path(spark, "test-tokens")
    token_files.write_token_files(no_docs, path, tokens.byte_level_encoder, BYTE, 0)
    assert token_files.read_token_files(spark, path).count() == 0


def check_packing(pieces, want, window, tasks):
    sequences, docs_ = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"] > 0
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        docs_[p["doc_id"]].append((p["start"], bytes(p["ids"]), p["doc_tokens"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= window
    total = sum(len(x) for x in want)
    assert sum(p["length"] for p in pieces) == total
    assert len(sequences) <= total // window + 1 + tasks
    return docs_


def test_packing_keeps_every_id(docs, no_docs):
    data = [r for r in rows() if r[0] not in (5, None)]
    part = docs.filter("doc_id <> 5")
    want = reference(WORD, 2, data)
    got = packing.pack(part, tokens.word_encoder, WORD, 2, window=256, open_windows=8).collect()
    parts = check_packing(got, want, 256, 5)
    for r, ids in zip(data, want):
        # rows that share an id are alike here: each piece of one stands as often as the row
        pieces, times = sorted(parts[r[0]]), sum(o[0] == r[0] for o in data)
        assert all(p[2] == len(ids) and p[1] == ids[p[0] : p[0] + len(p[1]) // 4].tobytes() for p in pieces)
        covered = np.zeros(len(ids) + 1, int)
        for start, some, _ in pieces:
            covered[start] += 1
            covered[start + len(some) // 4] -= 1
        assert (np.cumsum(covered)[:-1] == times).all()
    everything = packing.pack(docs, tokens.word_encoder, WORD, 2).collect()
    check_packing(everything, reference(WORD, 2, rows()), 4096, 5)
    assert packing.pack(no_docs, tokens.word_encoder, WORD, 2).count() == 0


def test_each_choice_is_the_least_sum_of_squares():
    """Against trying every fill: the chosen one gives the smallest sum of squared counts."""
    rnd = random.Random(1)
    packer = packing.SquaresPacker(16, 10_000, 0)
    for n in range(400):
        size = rnd.randint(1, 15)
        before = packer.level.copy()
        packer.add(n, np.zeros(size, "<u4"))
        best = None
        for h in range(0, 16 - size + 1):
            if h and not before[h]:
                continue
            trial = before.copy()
            if h:
                trial[h] -= 1
            if h + size < 16:
                trial[h + size] += 1
            best = min(x for x in (best, int((trial[1:16] ** 2).sum())) if x is not None)
        assert int((packer.level[1:16] ** 2).sum()) == best
    assert packer.level[0] == packer.level[16] == 0


def test_crc_of_pieces(spark):
    from pyspark.sql import functions as F

    one = packing.pack(frame(spark, [(1, "hello world", None, None, 1, 1, 1, "")]), tokens.word_encoder, WORD, 2)
    got = one.select(F.crc32("ids").alias("c"), "length").first()
    want = reference(WORD, 2, [(1, "hello world")])[0]
    assert (got["c"], got["length"]) == (zlib.crc32(want.tobytes()), len(want))
