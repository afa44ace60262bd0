"""One name for all spellings of a package: ``scikit_learn``, ``Scikit.Learn`` and ``scikit-learn`` meet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgatlas.functions.names import normalize_name


def alias_table(*spellings: DataFrame) -> DataFrame:
    """(canonical_key, canonical_name, spellings): one row per name after ``normalize_name``.

    Each of ``spellings`` has ``name`` and may have ``weight``. Where spellings collide, the one
    with the largest summed weight is the canonical name, then the smallest; ``spellings`` is
    their number. Counted map-side twice, so a name that most rows hold costs a row per task.
    Null names are left out.
    """
    named = [
        df.select("name", F.coalesce(F.col("weight") if "weight" in df.columns else F.lit(None), F.lit(0)).cast("long").alias("weight"))
        for df in spellings
    ]
    each = (
        reduce(DataFrame.unionByName, named).filter(F.col("name").isNotNull())
        .groupBy("name").agg(F.sum("weight").alias("weight"))
        .withColumn("canonical_key", normalize_name(F.col("name")))
    )
    return each.groupBy("canonical_key").agg(
        F.min(F.struct((-F.col("weight")).alias("w"), "name")).alias("best"), F.count("*").alias("spellings")
    ).select("canonical_key", F.col("best.name").alias("canonical_name"), "spellings")


def resolve_names(df: DataFrame, name_col: str, aliases: DataFrame) -> DataFrame:
    """``df`` with ``name_col`` as its canonical name; a name that no alias covers stays.

    Every later join by name then meets whatever the spelling was, known or not to the table.
    One row per key on the right, so no row is doubled, and a hot name on the left can be split.
    """
    known = aliases.select(F.col("canonical_key").alias("_key"), F.col("canonical_name").alias("_name"))
    joined = df.withColumn("_key_of", normalize_name(F.col(name_col))).join(known, F.col("_key_of") == F.col("_key"), "left")
    return joined.withColumn(name_col, F.coalesce("_name", name_col)).select(*df.columns)
