"""First meaningful code example of a README, as one native expression.

Order: fences tagged Python, then other fences whose tag is not skipped, then indented
blocks, which must also look like Python. Install-only and prose blocks never count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pkgatlas import fixed

# FIXED VALUES: block shapes. (?U) and (?d) give Unicode classes and \n-only line ends.
TAGGED_FENCE = r"(?Udsi)```(?:python|py)\s*\n(.*?)```"
ANY_FENCE = r"(?Uds)```(\w*)\s*\n(.*?)```"
CODE_SIGNAL = r"(?Udm)(^import |^from .+ import |^def |^class |^>>> |[=()\[\]{}]|^\w+\.)"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"

_OTHER_LINE = r"(?dm)^(?!(?: {4}|\t).).*$"
_INNER_INDENT = r"(?d)^(?: {4}|\t).+(?: {4}|\t)."
_MARK = "\x00"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def _is_install(line: Column) -> Column:
    """An install command with one argument, after an optional prompt sign."""
    line = strip(line)
    command = F.when(F.startswith(line, F.lit("$")), strip(F.substring(line, 2, 1 << 30))).otherwise(line)
    words = F.split(command, r"(?U)\s+")
    head = F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " ")
    return head.isin(*fixed.INSTALL_COMMANDS)


def is_trivial_install(code: Column) -> Column:
    """Every non-blank line is one install command; empty counts as trivial."""
    lines = F.filter(F.split(strip(code), LINE_BREAK), lambda line: strip(line) != "")
    return F.forall(lines, _is_install)


def looks_like_code(code: Column, strict: bool = False) -> Column:
    """First line is no HTML, bold, link or bullet; strict also wants a code token."""
    first = strip(F.substring_index(code, "\n", 1))
    html = F.startswith(first, F.lit("<")) & F.contains(first, F.lit(">"))
    prose = (
        F.contains(first, F.lit("**"))
        | F.startswith(first, F.lit("["))
        | F.startswith(first, F.lit("*"))
    )
    ok = ~html & ~prose
    return ok & code.rlike(CODE_SIGNAL) if strict else ok


def _first_good(blocks: Column, strict: bool = False) -> Column:
    good = F.filter(
        F.transform(blocks, strip),
        lambda c: (c != "") & ~is_trivial_install(c) & looks_like_code(c, strict),
    )
    return F.get(good, F.lit(0))


def _indented_blocks(readme: Column) -> Column:
    """Runs of indented lines, at least two lines long, with the indent taken off.

    Lines that are not indented are replaced by a mark and the text is cut there: the
    regex works line by line, so a long block costs no deep recursion. A lone line
    counts too when it holds a second indent inside, as a repeated group would match it.
    """
    cut = F.split(F.regexp_replace(readme, _OTHER_LINE, _MARK), _MARK)
    runs = F.transform(cut, lambda r: F.trim(r, F.lit("\n")))
    runs = F.filter(runs, lambda r: F.contains(r, F.lit("\n")) | r.rlike(_INNER_INDENT))
    return F.transform(
        runs,
        lambda r: F.array_join(
            F.transform(
                F.split(r, LINE_BREAK),
                lambda line: F.when(
                    F.startswith(line, F.lit("    ")), F.substring(line, 5, 1 << 30)
                ).otherwise(F.substring(line, 2, 1 << 30)),
            ),
            "\n",
        ),
    )


def code_snippet(readme: Column) -> Column:
    """Code text, or null when the README has none."""
    tagged = F.regexp_extract_all(readme, F.lit(TAGGED_FENCE), F.lit(1))
    fences = F.arrays_zip(
        F.regexp_extract_all(readme, F.lit(ANY_FENCE), F.lit(1)).alias("tag"),
        F.regexp_extract_all(readme, F.lit(ANY_FENCE), F.lit(2)).alias("code"),
    )
    skipped = F.array(*[F.lit(t) for t in fixed.SKIPPED_FENCE_TAGS])
    others = F.transform(
        F.filter(fences, lambda f: ~F.array_contains(skipped, F.lower(f["tag"]))),
        lambda f: f["code"],
    )
    fenced = F.when(
        F.contains(readme, F.lit("```")), F.coalesce(_first_good(tagged), _first_good(others))
    )
    return F.coalesce(fenced, _first_good(_indented_blocks(readme), strict=True))
