"""Query keys, significant words, intent flags, text composition."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pkgatlas import fixed
from pkgatlas.functions.names import BLANKS


def query_part(query: Column, max_chars: int | None = None) -> Column:
    """Trimmed, lower-cased, spaces to underscores; ``fixed.QUERY_KEY_CHARS`` gives the original's short key."""
    folded = F.replace(F.lower(F.trim(query, F.lit(BLANKS))), F.lit(" "), F.lit("_"))
    return folded if max_chars is None else F.substring(folded, 1, max_chars)


def query_key(query: Column, mode: Column, max_chars: int | None = None) -> Column:
    return F.concat(query_part(query, max_chars), F.lit("__"), mode)


def significant_words(text: Column, stop_words: Sequence[str] = fixed.STOP_WORDS) -> Column:
    """Distinct lower-case words longer than one character that are not stop words."""
    words = F.split(F.lower(text), r"(?U)\s+")
    stops = F.array(*[F.lit(w) for w in stop_words])
    return F.array_distinct(
        F.filter(words, lambda w: (F.length(w) > 1) & ~F.array_contains(stops, w))
    )


def growth_intent(query: Column, stems: Sequence[str] = fixed.GROWTH_STEMS) -> Column:
    return contains_any([query], stems)


def specific_domain(query: Column, words: Sequence[str] = fixed.DOMAIN_WORDS) -> Column:
    """The query names a concrete field; the growth override must then not apply."""
    return query.rlike(r"(?iU)\b(" + "|".join(words) + r")\b")


def contains_any(columns: Sequence[Column], terms: Sequence[str]) -> Column:
    """Any column holds any term, ignoring case; a null column never matches."""
    tests = [
        F.coalesce(F.contains(F.lower(c), F.lit(t.lower())), F.lit(False))
        for c in columns
        for t in terms
    ]
    return reduce(lambda a, b: a | b, tests)


def preview(text: Column, max_chars: int) -> Column:
    """Display cut, e.g. 500 characters of a result or 3000 of a code file."""
    return F.substring(text, 1, max_chars)


def embedding_text(
    name: Column,
    summary: Column,
    readme: Column,
    keywords: Column,
    classifiers: Column,
    readme_chars: int | None = None,
) -> Column:
    """Text to embed, one part per line, blank parts left out.

    The whole README is used; ``readme_chars=8000`` gives the shorter form of the original.
    """
    if readme_chars is not None:
        readme = preview(readme, readme_chars)
    labels = F.concat_ws(", ", F.from_json(classifiers, "array<string>"))
    parts = [name, summary, readme, keywords, labels]
    return F.concat_ws("\n", *[F.when(p != "", p) for p in parts])
