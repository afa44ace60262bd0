"""Quality rules whose cutoffs carry a bound on false rejections.

Statistics are plain column expressions. Labelled documents are split in two: one half
proposes a cutoff for each rule and stratum, the other half tests it with the exact binomial
tail; Holm's step-down corrects for the number of tests. Only certified cutoffs reject.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pkgatlas.llm.common import WORD_CLASS, materialize, text_or_empty, words_of

#: A rule rejects a document whose statistic is above the cutoff; these cutoffs are tried.
RULES: Mapping[str, Sequence[float]] = {
    "symbol_ratio": (0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0),
    "dup_line_ratio": (0.1, 0.2, 0.3, 0.4, 0.5, 0.7),
    "repeat_ratio": (0.1, 0.15, 0.2, 0.3, 0.4),
    "long_words": (8.0, 10.0, 12.0, 16.0, 24.0),
}
MAX_FALSE_REJECTION = 0.02
CONFIDENCE_GAP = 0.05
COST_OF_GOOD = 5
SYMBOLS = "#*$%&|<>"


def text_statistics(docs: DataFrame, text_col: str = "text", columns: Sequence[str] = ()) -> DataFrame:
    """``columns`` of ``docs``, mark (XXH64 of the text), n_words, word_chars, n_symbols,
    n_full_lines, n_dup_lines, n_repeat_words.

    All over the whole text; a null text has none of anything. Repeats of 3-word windows are
    found by sorting their 64-bit hashes inside the row, so the cost stays near linear in the
    length of a text and nothing is shuffled.
    """
    text = text_or_empty(F.col(text_col))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD_CLASS))
    base = docs.select(
        F.struct(F.xxhash64(text).alias("mark"), *columns).alias("keep"),
        words_of(text).alias("w"),
        lines.alias("lines"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    hashed = base.select(
        "keep", "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_full_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("w") >= 4,
            F.sort_array(
                F.transform(
                    F.sequence(F.lit(0), F.size("w") - 3),
                    lambda i: F.struct(
                        F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h"),
                        i.alias("i"),
                    ),
                )
            ),
        ).alias("s"),
    )
    repeated = hashed.select(
        "*",
        F.sort_array(
            F.transform(
                F.filter(
                    "s",
                    lambda x, k: ((k > 0) & (x["h"] == F.get("s", k - 1)["h"]))
                    | F.coalesce(x["h"] == F.get("s", k + 1)["h"], F.lit(False)),
                ),
                lambda x: x["i"],
            )
        ).alias("d"),
    )
    # a window covers three words, fewer where the next repeated window begins
    covered = F.aggregate(
        F.transform("d", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("d", k + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"), lambda total, x: total + x,
    )
    counted = repeated.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    return counted.select(
        *[F.col("keep")[c].alias(c) for c in columns], F.col("keep")["mark"].alias("mark"),
        "n_words", "word_chars", "n_symbols", "n_full_lines", "n_dup_lines", "n_repeat_words",
    )


def _ratio(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))


def rule_statistics() -> dict[str, Column]:
    return {
        "symbol_ratio": _ratio("n_symbols", "n_words"),
        "dup_line_ratio": _ratio("n_dup_lines", "n_full_lines"),
        "repeat_ratio": _ratio("n_repeat_words", "n_words"),
        "long_words": _ratio("word_chars", "n_words"),
    }


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), summed term by term in logarithms."""
    odds = F.log(F.lit(p / (1 - p)))
    first = n * F.log(F.lit(1 - p))

    def add(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1) / i) + odds
        top = F.greatest(s["total"], term)
        return F.struct(
            term.alias("term"),
            (top + F.log(F.exp(s["total"] - top) + F.exp(term - top))).alias("total"),
        )

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), F.least(k, n))).otherwise(
        F.array().cast("array<bigint>")
    )
    return F.least(
        F.lit(1.0),
        F.aggregate(
            steps, F.struct(first.alias("term"), first.alias("total")), add, lambda s: F.exp(s["total"])
        ),
    )


def proposal_half(id_col: str) -> Column:
    """A fixed half of the ids, by the upper bits of a product."""
    return F.pmod(F.col(id_col).cast("long") * 40503, F.lit(65536)) < 32768


def certified_cutoffs(
    stats: DataFrame,
    labels: DataFrame,
    stratum_col: str,
    id_col: str = "doc_id",
    quality_col: str = "quality",
    rules: Mapping[str, Sequence[float]] = RULES,
    max_false_rejection: float = MAX_FALSE_REJECTION,
    gap: float = CONFIDENCE_GAP,
    cost_of_good: int = COST_OF_GOOD,
) -> DataFrame:
    """One row per stratum and rule: cutoff, n_good, n_false, p_value, certified.

    ``stats`` holds id, stratum and the rules' columns. The proposing half picks the cutoff
    with the largest (bad rejected - cost_of_good * good rejected), the mildest among ties;
    none where that is not above 0. On the other half, n_false of n_good good documents are
    above it; p_value = P(Bin(n_good, max_false_rejection) <= n_false). Holm's procedure over
    all proposals keeps the chance that any certified rule's true rate is above the limit at
    ``gap`` or less. Documents without a label, or with a null one, are not used; a document
    labelled twice counts twice. No labels give no rows. A null stratum is one of its own.
    """
    known = labels.filter(F.col(quality_col).isNotNull()).select(
        F.col(id_col).alias("__id"), (F.col(quality_col) > 0).alias("good")
    )
    joined = stats.join(known, stats[id_col] == known["__id"]).select(
        F.col(stratum_col).alias("stratum"), "good", proposal_half(id_col).alias("proposing"),
        F.explode(F.array(*[
            F.struct(
                F.lit(name).alias("rule"),
                # how many of the cutoffs it is above
                F.aggregate(
                    F.array(*[(F.col(name) > c).cast("int") for c in cutoffs]), F.lit(0), lambda a, x: a + x
                ).alias("above"),
            )
            for name, cutoffs in rules.items()
        ])).alias("r"),
    )
    counts = joined.groupBy("stratum", "r.rule", "r.above").agg(
        F.count_if(F.col("proposing") & F.col("good")).alias("propose_good"),
        F.count_if(F.col("proposing") & ~F.col("good")).alias("propose_bad"),
        F.count_if(~F.col("proposing") & F.col("good")).alias("hold_good"),
    )
    at_least = Window.partitionBy("stratum", "rule").orderBy(F.col("above").desc())
    whole = Window.partitionBy("stratum", "rule")
    # a document above j cutoffs is rejected by the j mildest; a row stands for cutoff number `above`
    steps = F.create_map(*[
        x for name, cutoffs in rules.items()
        for x in (F.lit(name), F.array(*[F.lit(float(c)) for c in sorted(cutoffs)]))
    ])
    curve = counts.select(
        "stratum", "rule", "above",
        F.sum("propose_good").over(at_least).alias("good_cut"),
        F.sum("propose_bad").over(at_least).alias("bad_cut"),
        F.sum("hold_good").over(at_least).alias("n_false"),
        F.sum("hold_good").over(whole).alias("n_good"),
    ).filter("above > 0").withColumn("cutoff", F.get(steps[F.col("rule")], F.col("above") - 1))
    best = Window.partitionBy("stratum", "rule").orderBy(
        (F.col("bad_cut") - cost_of_good * F.col("good_cut")).desc(), F.col("above").desc()
    )
    proposed = (
        curve.withColumn("place", F.row_number().over(best))
        .filter((F.col("place") == 1) & (F.col("bad_cut") > cost_of_good * F.col("good_cut")))
        .withColumn("p_value", binomial_tail(F.col("n_false"), F.col("n_good"), max_false_rejection))
    )
    # one row per stratum and rule
    by_p = Window.orderBy("p_value", F.col("stratum").asc_nulls_last(), "rule")
    everything = Window.partitionBy()
    holm = proposed.withColumn("step", F.row_number().over(by_p)).withColumn(
        "tests", F.count("*").over(everything)
    ).withColumn("fits", F.col("p_value") <= gap / (F.col("tests") - F.col("step") + 1))
    return holm.select(
        "stratum", "rule", "cutoff", "n_good", "n_false", "p_value",
        F.min("fits").over(by_p.rowsBetween(Window.unboundedPreceding, 0)).alias("certified"),
    )


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    stratum_col: str = "lang",
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: Mapping[str, Sequence[float]] = RULES,
    max_false_rejection: float = MAX_FALSE_REJECTION,
    gap: float = CONFIDENCE_GAP,
) -> DataFrame:
    """Per document: id, stratum, mark (XXH64 of its text), the statistics, base_failed, kept.

    base_failed: under 50 words, or over half of the words in repeated 3-word windows. kept:
    not base_failed and under every certified cutoff of its stratum. A stratum without
    certified cutoffs rejects nothing further. Null text has no words, so it fails; a null id
    or stratum is scored like any other (a null id has no label). Repeated rows are scored
    each. Further columns are ignored. An empty table gives an empty table.
    """
    stats = text_statistics(docs, text_col, [id_col, stratum_col]).withColumns(rule_statistics())
    # the texts are gone over once; the labels and the verdicts read the numbers
    stats = materialize(stats, "quality-stats")
    cutoffs = certified_cutoffs(
        stats, labels, stratum_col, id_col, rules=rules,
        max_false_rejection=max_false_rejection, gap=gap,
    ).filter("certified")
    # a row per stratum; its stored size decides how it is joined
    limits = materialize(
        cutoffs.groupBy("stratum").agg(
            *[F.min(F.when(F.col("rule") == name, F.col("cutoff"))).alias(f"max_{name}") for name in rules]
        ),
        "quality-cutoffs",
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    beyond = F.lit(False)
    for name in rules:
        beyond = beyond | F.coalesce(F.col(name) > F.col(f"max_{name}"), F.lit(False))
    return stats.join(limits, stats[stratum_col].eqNullSafe(limits["stratum"]), "left").select(
        stats[id_col], stats[stratum_col], "mark", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~beyond).alias("kept"),
    )


def keep_documents(
    docs: DataFrame,
    labels: DataFrame,
    stratum_col: str = "lang",
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: Mapping[str, Sequence[float]] = RULES,
) -> DataFrame:
    """Rows of ``docs`` that ``score_documents`` keeps, all columns; rows alike share a verdict."""
    scored = score_documents(docs, labels, stratum_col, id_col, text_col, rules)
    # the rejected are fewer than the kept; a stratum is part of the verdict
    bad = scored.filter(~F.col("kept")).select(
        F.col(id_col).alias("_id"), F.col("mark").alias("_mark"), F.col(stratum_col).alias("_stratum")
    )
    own = F.xxhash64(text_or_empty(F.col(text_col)))
    return docs.join(
        bad,
        docs[id_col].eqNullSafe(F.col("_id")) & (own == F.col("_mark")) & docs[stratum_col].eqNullSafe(F.col("_stratum")),
        "left_anti",
    )
