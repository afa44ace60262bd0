"""Rows that every operator over documents must bear, and plain versions of the contracts."""

import re

WHITE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, size long, copies string"

LINES = ["A shared line of text", "another line, also shared", "short", "Ünïcode zeile ist hier", "", "   "]


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing columns."""
    out = []
    for i in range(40):
        text = "\n".join([LINES[i % 6], f"line {i} of its own here", LINES[(i + 1) % 6] + " \t", " ".join(f"w{(i * j) % 17}" for j in range(i * 3))])
        out.append((i, text, ("en", "de", None)[i % 3], ("a", "b", None, "c")[i % 4], len(text), 7, 8, "x"))
    long = "\n".join(f"a very long text has line {j % 700} and word{j}" for j in range(20_000))
    fine = " ".join(f"unique{j}" for j in range(80))
    out += [
        (40, None, "en", "a", 0, None, None, None), (41, "", "en", "a", 0, 1, 1, "y"), (42, long, "en", "b", len(long), 1, 1, "y"),
        (None, "no id but a shared line\nA shared line of text", None, None, None, None, None, None),
        (43, out[5][1], "de", "b", 5, 1, 1, "z"), (44, out[5][1], "de", "b", 5, 1, 1, "z"),
        (5, *out[5][1:]), (5, *out[5][1:]), (45, "\n\n \n", "en", "a", 4, 1, 1, "y"), (46, "one", "en", "a", 3, 1, 1, "y"),
        (47, fine, "en", "b", len(fine), 1, 1, "y"), (48, fine + "\nwith a line more", "fr", "c", 1, 1, 1, "y"),
        (49, fine.upper(), None, None, None, 1, 1, "y"), (49, fine.upper(), None, None, None, 1, 1, "y"),
    ]
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(5)
