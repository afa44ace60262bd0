"""Check the numbers an answer cites against the statistics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgatlas.functions.names import name_key

# FIXED VALUE: a citation is "<package> has <number> <metric>", number with optional commas.
CITATION = r"(?i)([a-z0-9][a-z0-9._-]*)\s+has\s+([0-9][0-9,]*)\s+(stars|dependents|forks)"
METRIC_COLUMNS = {"stars": "stars", "dependents": "dependents_count", "forks": "forks"}


def extract_citations(answers: DataFrame) -> DataFrame:
    """One row per citation: (answer_id, pos, name, metric, cited)."""
    groups = [F.regexp_extract_all("text", F.lit(CITATION), F.lit(g)) for g in (1, 2, 3)]
    zipped = F.arrays_zip(
        groups[0].alias("name"), groups[1].alias("number"), groups[2].alias("metric")
    )
    return answers.select("answer_id", F.posexplode(zipped).alias("pos", "c")).select(
        "answer_id",
        "pos",
        "c.name",
        F.lower("c.metric").alias("metric"),
        F.replace(F.col("c.number"), F.lit(","), F.lit("")).try_cast("long").alias("cited"),
    )


def check_citations(
    answers: DataFrame, stats: DataFrame, columns: Mapping[str, str] = METRIC_COLUMNS
) -> DataFrame:
    """Citations with the true value and a match flag. ``stats`` needs ``name_key``."""
    cited = extract_citations(answers).withColumn("name_key", name_key(F.col("name")))
    facts = stats.select("name_key", *columns.values())
    joined = cited.join(facts, "name_key", "left")
    actual = None
    for metric, column in columns.items():
        hit = F.col("metric") == metric
        actual = F.when(hit, F.col(column)) if actual is None else actual.when(hit, F.col(column))
    return joined.withColumn("actual", actual).select(
        "answer_id", "pos", "name", "metric", "cited", "actual",
        F.coalesce(F.col("cited") == F.col("actual"), F.lit(False)).alias("matched"),
    )


def grounding(answers: DataFrame, checked: DataFrame) -> DataFrame:
    """Per answer: citations, matches and the label direct / partial / insufficient."""
    counts = checked.groupBy("answer_id").agg(
        F.count("*").alias("citations"), F.count_if("matched").alias("matches")
    )
    label = (
        F.when((F.col("citations") > 0) & (F.col("matches") == F.col("citations")), "direct")
        .when(F.col("matches") > 0, "partial")
        .otherwise("insufficient")
    )
    zero = F.lit(0).cast("long")
    return (
        answers.select("answer_id")
        .join(counts, "answer_id", "left")
        .withColumns(
            {"citations": F.coalesce("citations", zero), "matches": F.coalesce("matches", zero)}
        )
        .withColumn("grounding", label)
    )
