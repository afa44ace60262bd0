"""Secret scans: three fixed patterns, and sliding-window entropy over candidate strings.

Only column expressions: a text is cut at its matches, so places follow from lengths.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgatlas.llm.common import text_or_empty

# The base patterns, in the order in which kinds are listed.
PATTERNS: Mapping[str, str] = {
    "assign": "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
}
KINDS = tuple(PATTERNS)
#: Least lengths; of the second group for assign, of the whole match for the others.
LEAST = {"assign": 6, "access": 20, "hex": 24}

CANDIDATE = "[A-Za-z0-9+/_-]{20,}"
WINDOW = 20
#: Character classes of candidates, by what all their characters are, and the least entropy of
#: a window in bits; log2(20) = 4.32 is the most a window of 20 can have.
CLASSES: Sequence[tuple[str, str, float]] = (
    ("hex", "[0-9a-fA-F]+", 3.12),
    ("alnum", "[A-Za-z0-9]+", 3.72),
    ("symbol", "[A-Za-z0-9+/_-]+", 3.82),
)
#: A candidate without both is a word or a number.
MIXED = ("[0-9]", "[A-Za-z]")
#: Suppressed although random: addresses, identifiers of other kinds, placeholders, sequences.
ALLOWED: Sequence[str] = (
    "(?i)example|sample|placeholder|changeme|dummy|lorem|test",
    "(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    "(?i)abcdefgh|12345678|87654321",
    "^[a-z]+(?:[/_-][a-z]+)+[0-9]{0,4}$",
    "^(?:[A-Za-z]+[0-9]{0,3}[/_-])+[A-Za-z]*[0-9]{0,4}$",
)


#: Elements that one inner fold puts together; the outer one joins whole chunks.
_CHUNK = 256


def scan(items: Column, start: Column, state_type: str, item_type: str,
         step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column]) -> Column:
    """``emit(state, item)`` for each item in order, where ``step`` makes the next state of the two.

    Arrays are copied when they grow, so items are folded a chunk at a time: a list of n costs
    about n * 256 copies, not n * n.
    """
    none = F.array().cast(f"array<{item_type}>")
    chunks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / F.lit(_CHUNK)).cast("int") - 1, F.lit(0))),
        lambda i: F.slice(items, i * _CHUNK + 1, _CHUNK),
    )

    def inner(s: Column, chunk: Column) -> Column:
        return F.aggregate(
            chunk, F.struct(s["at"].alias("at"), none.alias("out")),
            lambda t, x: F.struct(
                step(t["at"], x).cast(state_type).alias("at"),
                F.concat(t["out"], F.array(emit(t["at"], x).cast(item_type))).alias("out"),
            ),
        )

    def outer(s: Column, chunk: Column) -> Column:
        # bound once, as it is used twice
        return F.get(F.transform(F.array(inner(s, chunk)), lambda r: F.struct(
            r["at"].alias("at"), F.concat(s["out"], r["out"]).alias("out"),
        )), F.lit(0))

    whole = F.aggregate(chunks, F.struct(start.cast(state_type).alias("at"), none.alias("out")), outer, lambda s: s["out"])
    return F.when(F.size(items) > 0, whole).otherwise(none)


def match_spans(text: Column, pattern: str, groups: Sequence[int] = (0,)) -> Column:
    """Leftmost matches that do not overlap: array of (start, end, group...), in code points.

    The pieces between matches and the matches alternate, so running sums of their lengths are
    the places. The pattern never matches the empty string.
    """
    found = F.arrays_zip(
        F.slice(F.transform(F.split(text, pattern, -1), F.length), 1, F.regexp_count(text, F.lit(pattern))).alias("gap"),
        *[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups],
    )

    def length(m: Column) -> Column:
        return F.length(m[f"g{groups[0]}"])

    spans = lambda found: scan(
        found, F.lit(0), "int", f"struct<start:int,end:int,{','.join(f'g{g}:string' for g in groups)}>",
        lambda at, m: at + m["gap"] + length(m),
        lambda at, m: F.struct(
            (at + m["gap"]).alias("start"), (at + m["gap"] + length(m)).alias("end"), *[m[f"g{g}"].alias(f"g{g}") for g in groups]
        ),
    )
    return F.get(F.transform(F.array(found), spans), F.lit(0))  # the text is cut once


def apart(spans: Column, base: Column) -> Column:
    """The ``spans`` (start, end, g0) that overlap no span of ``base`` (start, end).

    Both lists are merged by their starts. Going forth, the furthest end so far tells whether an
    earlier base span reaches in; going back, the next start tells whether a later one does.
    """
    kind = "struct<start:int,own:int,end:int,g0:string,hit:boolean>"

    def event(x: Column, own: int) -> Column:
        return F.struct(
            x["start"].alias("start"), F.lit(own).alias("own"), x["end"].alias("end"),
            (x["g0"] if own else F.lit(None).cast("string")).alias("g0"), F.lit(False).alias("hit"),
        )

    def marked(x: Column, hit: Column) -> Column:
        return F.struct(x["start"], x["own"], x["end"], x["g0"], (x["hit"] | hit).alias("hit"))

    def forth(events: Column) -> Column:
        return scan(
            events, F.lit(-1), "int", kind,
            lambda far, x: F.when(x["own"] == 0, F.greatest(far, x["end"])).otherwise(far),
            lambda far, x: marked(x, far > x["start"]),
        )

    def back(events: Column) -> Column:
        return scan(
            F.reverse(events), F.lit(2**31 - 1), "int", kind,
            lambda near, x: F.when(x["own"] == 0, x["start"]).otherwise(near),
            lambda near, x: marked(x, near < x["end"]),
        )

    result = F.array_sort(F.concat(
        F.transform(base, lambda x: event(x, 0)), F.transform(spans, lambda x: event(x, 1))
    ))
    for fold in (forth, back):
        result = F.get(F.transform(F.array(result), fold), F.lit(0))
    left = F.filter(F.reverse(result), lambda x: (x["own"] == 1) & ~x["hit"])
    return F.transform(left, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["g0"].alias("g0")))


def _xlog(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def window_entropy(text: Column, window: int) -> Column:
    """Largest Shannon entropy (bits) of a window of ``text``, which has at least ``window`` characters.

    The counts of the characters in the window are kept while it slides: one goes down, one goes
    up, and the entropy's sum follows from these two alone.
    """
    chars = F.split(text, "")
    letters = F.array_distinct(chars)
    places = F.transform(chars, lambda c: F.array_position(letters, c).cast("int") - 1)
    packed = F.struct(places.alias("p"), F.size(letters).alias("n"))

    def over(x: Column) -> Column:
        zero = F.struct(
            F.array_repeat(F.lit(0), x["n"]).alias("c"), F.lit(0.0).alias("s"), F.lit(float("inf")).alias("low"),
        )

        def step(state: Column, i: Column) -> Column:
            enters = F.get(x["p"], i)
            leaves = F.when(i >= window, F.get(x["p"], i - window)).otherwise(-1)
            before = F.get(state["c"], enters)
            gone = F.coalesce(F.get(state["c"], leaves), F.lit(0))
            same = enters == leaves
            s = F.when(same, state["s"]).otherwise(
                state["s"] + _xlog(before + 1) - _xlog(before) + _xlog(gone - 1) - _xlog(gone)
            )
            c = F.transform(
                state["c"],
                lambda v, k: v + F.when(k == enters, 1).otherwise(0) - F.when(k == leaves, 1).otherwise(0),
            )
            low = F.when(i >= window - 1, F.least(state["low"], s)).otherwise(state["low"])
            return F.struct(c.alias("c"), s.alias("s"), low.alias("low"))

        return F.aggregate(F.sequence(F.lit(0), F.size(x["p"]) - 1), zero, step, lambda z: z["low"])

    low = F.get(F.transform(F.array(packed), over), F.lit(0))
    return F.round(F.log2(F.lit(float(window))) - low / F.lit(float(window)), 6)


def _spans_text(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    classes: Sequence[tuple[str, str, float]] = CLASSES,
    allowed: Sequence[str] = ALLOWED,
) -> DataFrame:
    """Per document: id, base and entropy (arrays of kind, start, end in code points, end exclusive).

    Base: the matches of each kind of ``PATTERNS``, leftmost and not overlapping, less those that
    are too short. Entropy: candidates of ``window`` characters or more that hold letters and
    digits, are not on the allow list, do not overlap a base span, and have a window above the
    least entropy of the first class they belong to; their kind is ``entropy-<class>``. Spans
    are in order of start, then kind as listed.

    Whole texts; null is empty, and has no span. Every row is scanned alone, so null ids,
    repeated rows and further columns make no difference and nothing is shuffled. A text without
    a pattern's fixed letters is not searched for it. An empty table gives an empty table.
    """
    text = F.col("text")
    none = "array<struct<start:int,end:int,g0:string{}>>"
    low = F.lower(text)
    named = F.lit(False)
    for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        named = named | F.contains(low, F.lit(word))
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    spanned = rows.select(
        "id", "text",
        F.when(named, match_spans(text, PATTERNS["assign"], (0, 2)))
        .otherwise(F.array().cast(none.format(",g2:string"))).alias("assign"),
        F.when(F.contains(text, F.lit("AKIA")), match_spans(text, PATTERNS["access"]))
        .otherwise(F.array().cast(none.format(""))).alias("access"),
        # a run is as long as it gets from its first character, so short ones can be left out at once
        F.when(text.rlike("[0-9a-f]{24}"), match_spans(text, "[0-9a-f]{24,}"))
        .otherwise(F.array().cast(none.format(""))).alias("hex"),
        F.when(text.rlike(CANDIDATE), match_spans(text, CANDIDATE))
        .otherwise(F.array().cast(none.format(""))).alias("candidates"),
    )

    def plain(kind: str, place: int, group: str) -> Column:
        return F.transform(
            F.filter(kind, lambda x: F.length(x[group]) >= LEAST[kind]),
            lambda x: F.struct(x["start"].alias("start"), F.lit(place).alias("place"), F.lit(kind).alias("kind"),
                               x["end"].alias("end")),
        )

    based = spanned.select(
        "id", "candidates",
        F.array_sort(F.concat(plain("assign", 0, "g2"), plain("access", 1, "g0"), plain("hex", 2, "g0"))).alias("base"),
    )

    def suspect(x: Column) -> Column:
        ok = F.length(x["g0"]) >= window
        for part in MIXED:
            ok = ok & x["g0"].rlike(part)
        for pattern in allowed:
            ok = ok & ~x["g0"].rlike(pattern)
        return ok

    def judged(x: Column) -> Column:
        kind, least = F.lit(None).cast("string"), F.lit(None).cast("double")
        for name, pattern, bits in reversed(classes):
            fits = x["g0"].rlike(f"^(?:{pattern})$")
            kind = F.when(fits, F.lit(f"entropy-{name}")).otherwise(kind)
            least = F.when(fits, F.lit(bits)).otherwise(least)
        return F.struct(
            x["start"].alias("start"), F.lit(3).alias("place"),
            F.when(window_entropy(x["g0"], window) > least, kind).alias("kind"), x["end"].alias("end"),
        )

    likely = based.select("id", "base", F.filter("candidates", suspect).alias("likely"))
    left = likely.select("id", "base", F.when(
        (F.size("likely") > 0) & (F.size("base") > 0), apart(F.col("likely"), F.col("base"))
    ).otherwise(F.col("likely")).alias("left"))
    scored = left.select(
        "id", "base",
        F.when(
            F.size("left") > 0,
            F.filter(F.transform("left", judged), lambda x: x["kind"].isNotNull()),
        ).otherwise(F.array().cast("array<struct<start:int,place:int,kind:string,end:int>>")).alias("entropy"),
    )
    return scored.select(F.col("id").alias(id_col), "base", "entropy")


def secret_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, a digest of the base spans, and all spans as text."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    return found.select(
        id_col, *[count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(_spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _spans_text(F.array_sort(F.concat("base", "entropy"))).alias("spans"),
    )
