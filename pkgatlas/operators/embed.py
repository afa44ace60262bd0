"""Text embedding: a native default and a hook for any batch provider."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pkgatlas.functions.text import embedding_text
from pkgatlas.functions.vectors import unit
from pkgatlas.operators.build import one_per_name
from pkgatlas.session import materialize

Provider = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def package_texts(
    packages: DataFrame, metadata: DataFrame, readme_chars: int | None = None
) -> DataFrame:
    """Embedding text per package (packages without a registry record have none)."""
    meta = one_per_name(metadata, "name")
    return packages.select("name_key", "package_name").join(meta, "name_key").select(
        "name_key",
        F.col("package_name").alias("name"),
        embedding_text(
            F.col("package_name"), F.col("summary"), F.col("readme"), F.col("keywords"),
            F.col("classifiers"), readme_chars,
        ).alias("embedding_text"),
    )


def _slot(token: Column, dim: int) -> Column:
    """Feature slot of a token, from the first 32 bits of its MD5."""
    bits = F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("long")
    return F.pmod(bits, F.lit(dim)).cast("int")


def hashed_tfidf(
    texts: DataFrame, id_col: str, text_col: str, dim: int = 256, use_idf: bool = True
) -> DataFrame:
    """(id, embedding): unit-length hashed TF-IDF vectors; plain counts without ``use_idf``.

    Tokens are counted per (row, slot) map-side, so at most ``dim`` small rows per text are
    shuffled and the text itself never is. The counts are stored once, because the slot
    weights need a first pass over them. Rows without a token get a zero vector.
    """
    token = F.col("_t")
    counts = (
        texts.select(id_col, F.explode_outer(F.split(F.lower(text_col), r"\s+")).alias("_t"))
        .groupBy(id_col, F.when(token != "", _slot(token, dim)).alias("slot"))
        .agg(F.count("*").alias("tf"))
    )
    bags = counts.groupBy(id_col).agg(
        F.map_from_entries(
            F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("slot", "tf")))
        ).alias("bag")
    )
    if use_idf:
        bags = materialize(bags, "token-counts")
        spread = bags.select(F.explode(F.map_keys("bag")).alias("slot")).groupBy("slot").agg(
            F.count("*").alias("df")
        )
        # `dim` entries at most, whatever the texts
        df = spread.agg(F.map_from_entries(F.collect_list(F.struct("slot", "df")))).scalar()
        total = bags.agg(F.count("*")).scalar()
        bags = bags.select("*", df.alias("_df"), total.alias("_rows"))
    slots = F.sequence(F.lit(0), F.lit(dim - 1))

    def value(i: Column) -> Column:
        if not use_idf:
            return F.coalesce(F.try_element_at("bag", i).cast("double"), F.lit(0.0))
        idf = F.ln((F.col("_rows") + 1) / (F.try_element_at("_df", i) + 1)) + 1.0
        return F.coalesce(F.try_element_at("bag", i) * idf, F.lit(0.0))

    return bags.select(id_col, F.transform(slots, value).alias("_v")).select(
        id_col, F.transform(unit(F.col("_v")), lambda x: x.cast("float")).alias("embedding")
    )


def embed_texts(
    df: DataFrame,
    id_col: str = "id",
    text_col: str = "embedding_text",
    provider: Provider | None = None,
    batch_size: int = 50,
    dim: int = 256,
) -> DataFrame:
    """(id, embedding, embed_error) for every row.

    Without a provider the native vectors are used. A provider gets lists of at most
    ``batch_size`` texts; when it fails, that batch keeps null vectors and the error text,
    and the rest goes on.
    """
    if provider is None:
        return hashed_tfidf(df, id_col, text_col, dim).withColumn(
            "embed_error", F.lit(None).cast("string")
        )
    schema = T.StructType(
        [
            df.schema[id_col],
            T.StructField("embedding", T.ArrayType(T.FloatType())),
            T.StructField("embed_error", T.StringType()),
        ]
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch_size):
                part = frame.iloc[at : at + batch_size]
                try:
                    vectors = [list(map(float, v)) for v in provider(part[text_col].tolist())]
                    if len(vectors) != len(part):
                        raise ValueError(f"{len(vectors)} vectors for {len(part)} texts")
                    error = None
                except Exception as exc:  # a failed call must not lose the other batches
                    vectors, error = [None] * len(part), f"{type(exc).__name__}: {exc}"
                yield pd.DataFrame(
                    {
                        id_col: part[id_col],
                        "embedding": pd.Series(vectors, index=part.index, dtype=object),
                        "embed_error": pd.Series([error] * len(part), index=part.index, dtype=object),
                    }
                )

    return df.select(id_col, text_col).mapInPandas(run, schema)
