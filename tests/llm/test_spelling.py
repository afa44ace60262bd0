import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import frame, lower, rows
from pkgatlas.llm import spelling
from pkgatlas.llm.queries import op12_spelling_variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_words(data, least=7, times=2):
    n = Counter()
    for r in data:
        for run in RUN.findall(r[1] or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= least and c >= times}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(n):
    """Near words by trying all words that one edit makes of each, over the letters in use."""
    letters = sorted(set("".join(n)))
    out = {}
    for w in n:
        if len(w) > 200:
            made = {v for v in n if near(w, v)}
        else:
            cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
            made = {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}
            made = {v for v in made if v in n and v != w}
        best = min(made, key=lambda v: (-n[v], v), default=None)
        out[w] = (best if best is not None and n[best] >= 10 * n[w] else None, len(made))
    rows_ = []
    for w, (form, count) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows_.append((w, form, root, n[w], count, n[form] if form else None))
    return sorted(rows_)


def got_rows(frame_):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in frame_.collect())


def variants(rnd, word, times):
    for _ in range(times):
        i, c = rnd.randrange(len(word)), rnd.choice("abcdezqéÉ÷")
        word = rnd.choice([word[:i] + word[i + 1 :], word[:i] + c + word[i:], word[:i] + c + word[i + 1 :]])
    return word


@pytest.mark.parametrize("block_words", [4096, 16])
def test_equals_brute_force(spark, block_words):
    rnd = random.Random(4)
    base = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(7, 12))) for _ in range(40)]
    base += ["e" * k for k in (60, 61, 62, 63, 64, 65, 66, 70)] + ["x" * 300, "x" * 301, "x" * 150 + "y" + "x" * 150, "nestling", "gnestlin"]
    data = []
    for i in range(300):
        some = [variants(rnd, rnd.choice(base), rnd.randint(0, 2)) for _ in range(30)] + [base[0]] * 12 + rnd.choices(base, k=20)
        rnd.shuffle(some)
        data.append((i, " ".join(w.title() if rnd.random() < 0.2 else w for w in some) + "\n1, 2", "en", "a", 1, 1, 1, "x"))
    data += [(None, f"{base[1]} {base[1]}", *[None] * 6), (5, None, *[None] * 6), (5, "", *[None] * 6), (5, data[5][1], *[None] * 6)]
    got = got_rows(spelling.spelling_groups(frame(spark, data), block_words=block_words))
    want = brute_groups(brute_words(data))
    assert got == want
    assert any(r[1] for r in want) and any(r[2] not in (r[0], r[1]) for r in want)


def test_search_finds_every_pair_within_the_budget():
    """Leaves reached: all pairs of words whose counts differ by one surplus and one deficit at most."""
    rnd = random.Random(8)
    words = sorted({"".join(rnd.choice("entaié") for _ in range(rnd.randint(1, 6))) for _ in range(400)})
    blob = lambda ws: "".join(w + "\n" for w in ws).encode("latin-1")
    left, right = spelling.Block(blob(words[::2]), 0), spelling.Block(blob(words[1::2]), 0)
    for budget in ((1, 1), (0, 1), (1, 0), (0, 0)):
        got = [(left.word(i), right.word(j)) for a, b in spelling.candidates(left, right, *budget) for i, j in zip(a.tolist(), b.tolist())]
        vector = lambda w: np.bincount(spelling._GROUP_OF[np.frombuffer(w, np.uint8)], minlength=spelling.LEVELS)
        want = set()
        for x in (w.encode("latin-1") for w in words[::2]):
            for y in (w.encode("latin-1") for w in words[1::2]):
                d = vector(y) - vector(x)
                if d[d > 0].sum() <= budget[0] and -d[d < 0].sum() <= budget[1]:
                    want.add((x, y))
        assert len(got) == len(set(got)) and set(got) == want


def test_large_batches_are_cut(monkeypatch):
    monkeypatch.setattr(spelling, "_FRONTIER", 7)
    words = ["".join(c) for c in itertools.product("ab", repeat=6)]
    block = spelling.Block("".join(w + "\n" for w in words).encode(), 0)
    got = [(i, j) for a, b in spelling.candidates(block, block, 1, 1) for i, j in zip(a.tolist(), b.tolist())]
    # counts of b differ by one at most
    want = sum(abs(x.count("b") - y.count("b")) <= 1 for x in words for y in words)
    assert len(got) == len(set(got)) == want


def test_hard_rows_and_empty_table(docs, no_docs):
    assert got_rows(spelling.spelling_groups(docs)) == brute_groups(brute_words(rows()))
    assert spelling.spelling_groups(no_docs).count() == 0


def test_query_on_the_table(spark, sf_dir):
    data = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert got_rows(op12_spelling_variants(spark, sf_dir)) == brute_groups(brute_words(data))
