"""Keyword, semantic and hybrid package search, query intent."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pkgatlas import fixed
from pkgatlas.functions import scoring
from pkgatlas.functions.names import name_key, with_name_key
from pkgatlas.functions.text import growth_intent, specific_domain
from pkgatlas.operators.build import dedupe_best
from pkgatlas.operators.lookup import Layers, first_non_empty
from pkgatlas.operators.rank import top_growth
from pkgatlas.operators.vector_search import vector_topk

MAX_LITERAL_KEYWORDS = 128
GRAM = 3


def query_intent(queries: DataFrame) -> DataFrame:
    """Growth flags (agent and search variant), concrete-field flag, growth override."""
    q = F.col("query")
    agent = growth_intent(q)
    return queries.withColumns(
        {
            "growth_intent": agent,
            "growth_intent_search": growth_intent(
                q, (*fixed.GROWTH_STEMS, *fixed.GROWTH_STEMS_SEARCH_ONLY)
            ),
            "specific_domain": specific_domain(q),
            "growth_override": agent & ~specific_domain(q),
        }
    )


def _keyword_topk(hits: DataFrame, limit: int) -> DataFrame:
    """Most used packages per query; cut per task before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(
        F.col("dependent_count").desc_nulls_last(), F.col("name_key").asc()
    )
    top = hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    return top.select(
        "query_id", "rank", F.col("package_name").alias("name"), "name_key",
        F.col("dependent_count").alias("dependents_count"), "stars", "growth_pct",
    )


_HIT_COLUMNS = ("package_name", "name_key", "dependent_count", "stars", "growth_pct")


def _literal_hits(
    packages: DataFrame, keywords: Sequence[tuple], id_type: str, text_col: str, wildcards: bool
) -> DataFrame:
    """One pass over the texts, each tested against a short list of literals."""
    text = F.col("_text")

    def test(keyword: str) -> Column:
        if wildcards:
            pattern = ("%" + keyword.lower() + "%").replace("\\", "\\\\")
            return text.like(pattern)
        return F.contains(text, F.lit(keyword.lower()))

    found = F.array_compact(
        F.array(*[F.when(test(k), F.lit(i).cast(id_type)) for i, k in keywords])
    )
    return packages.select(*_HIT_COLUMNS, F.lower(text_col).alias("_text")).select(
        *_HIT_COLUMNS, F.explode(found).alias("query_id")
    )


def _grams(text: Column, size: int) -> Column:
    """Distinct substrings of ``size`` characters; none when the text is shorter."""
    last = F.length(text) - (size - 1)
    return F.when(
        last >= 1,
        F.array_distinct(
            F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(text, i, F.lit(size)))
        ),
    )


def _longest_literal(keyword: Column) -> Column:
    """The longest part of a pattern that holds no wildcard; empty when there is none."""
    return F.reduce(
        F.split(keyword, "[%_]"), F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a)
    )


def _gram_hits(packages: DataFrame, keywords: DataFrame, text_col: str, wildcards: bool) -> DataFrame:
    """Substring join for many keywords without comparing every pair.

    A text holding a keyword holds all 3-grams of its longest literal part. Each keyword is
    filed under the one of these grams that fewest texts hold; names of texts meet it there, and
    the texts themselves join once, to verify. Parts of one or two characters are their own
    gram. Only names travel with the grams.
    """
    texts = packages.select(*_HIT_COLUMNS, F.lower(text_col).alias("_text"))
    kw = keywords.withColumn("_kw", F.lower("keyword"))
    kw = kw.withColumn("_part", _longest_literal(F.col("_kw")) if wildcards else F.col("_kw")).withColumn(
        "_size", F.least(F.length("_part"), F.lit(GRAM))
    )
    candidates = keywords.select(F.lit(None).cast("string").alias("name_key"), "query_id", F.col("keyword").alias("_kw")).limit(0)
    # at most GRAM rows: the lengths that occur
    for size in sorted(r[0] for r in kw.filter("_size > 0").select("_size").distinct().collect()):
        sized = kw.filter(F.col("_size") == size)
        parts = sized.select("query_id", "_kw", F.explode(_grams(F.col("_part"), size)).alias("gram"))
        in_texts = texts.select("name_key", F.explode(_grams(F.col("_text"), size)).alias("gram"))
        spread = (
            in_texts.select("gram").join(parts.select("gram").distinct(), "gram", "left_semi")
            .groupBy("gram").agg(F.count("*").alias("texts"))
        )
        anchors = (
            parts.join(spread, "gram")
            .groupBy("query_id", "_kw")
            .agg(F.min(F.struct("texts", "gram")).alias("a"))
            .select("query_id", "_kw", F.col("a.gram").alias("gram"))
        )
        met = in_texts.join(anchors, "gram").select("name_key", "query_id", "_kw")
        candidates = candidates.unionByName(met)
    holds = F.contains("_text", "_kw")
    if wildcards:
        pattern = F.concat(F.lit("%"), F.replace(F.col("_kw"), F.lit("\\"), F.lit("\\\\")), F.lit("%"))
        holds = F.like(F.col("_text"), pattern)
    found = candidates.distinct().join(texts, "name_key").filter(holds).select(*_HIT_COLUMNS, "query_id")
    if not wildcards:
        return found
    # patterns of wildcards alone hold in every text that is long enough
    lengths = F.length(F.replace(F.col("_kw"), F.lit("%"), F.lit("")))
    bare = kw.filter(F.col("_size") == 0).select("query_id", lengths.alias("_least"))
    longest = bare.agg(F.max("_least")).first()[0]
    if longest is None:
        return found
    # a text meets every length up to its own
    reach = texts.filter(F.col("_text").isNotNull()).select(
        *_HIT_COLUMNS, F.explode(F.sequence(F.lit(0), F.least(F.length("_text"), F.lit(longest)))).alias("_least")
    )
    return found.unionByName(reach.join(bare, "_least").select(*_HIT_COLUMNS, "query_id"))


def keyword_search(
    packages: DataFrame,
    keywords: Sequence[str] | DataFrame,
    limit: int = 20,
    text_col: str = "description",
    wildcards: bool = False,
    max_literals: int = MAX_LITERAL_KEYWORDS,
) -> DataFrame:
    """Packages whose text holds the keyword, ignoring case; ``limit`` most used per keyword.

    ``keywords`` is a list (query_id is then the position) or a frame (query_id, keyword); a row
    told twice counts once. A short list is tested in one pass over the texts; a long one goes
    through 3-grams, with the same result. The keyword is taken literally; ``wildcards=True``
    lets % and _ match anything.
    """
    spark = packages.sparkSession
    if not isinstance(keywords, DataFrame):
        keywords = spark.createDataFrame(
            [(i, k) for i, k in enumerate(keywords)], "query_id int, keyword string"
        )
    keywords = keywords.select("query_id", "keyword").filter(F.trim("keyword") != "").distinct()
    id_type = keywords.schema["query_id"].dataType.simpleString()
    rows = [tuple(r) for r in keywords.limit(max_literals + 1).collect()]
    if not rows:
        hits = packages.select(*_HIT_COLUMNS).withColumn("query_id", F.lit(None).cast(id_type))
        return _keyword_topk(hits.filter(F.lit(False)), limit)
    if len(rows) <= max_literals:
        return _keyword_topk(_literal_hits(packages, rows, id_type, text_col, wildcards), limit)
    return _keyword_topk(_gram_hits(packages, keywords, text_col, wildcards), limit)


def keyword_search_layers(
    layers: Layers, keywords: Sequence[str] | DataFrame, limit: int = 20, **options
) -> DataFrame:
    """Hits in the fresh packages; a keyword without any is searched in the historical ones."""
    old = None
    if layers.projects is not None:
        old = keyword_search(
            with_name_key(layers.projects, "name").select(
                F.col("name").alias("package_name"), "name_key", F.col("dependents_count").alias("dependent_count"),
                "stars", F.lit(None).cast("double").alias("growth_pct"), "description",
            ),
            keywords, limit, **options,
        )
    if layers.fresh is None:
        return old
    new = keyword_search(layers.fresh, keywords, limit, **options)
    return new if old is None else first_non_empty(new, old, ["query_id"])


def semantic_search(
    corpus: DataFrame,
    queries: DataFrame,
    limit: int = 20,
    threshold: float = fixed.SEARCH_SCORE_THRESHOLD,
    min_dependents: int = fixed.SEARCH_MIN_DEPENDENTS,
    weights: Mapping[str, float] = fixed.BLEND_WEIGHTS,
) -> DataFrame:
    """Packages ranked by similarity, popularity and growth together.

    Little-used packages go before anything is scored, and the blend itself decides who stays
    in the running top list, so no qualified package is lost. ``corpus``: id, embedding, name,
    stars, dependent_count, growth_pct.
    """
    used = corpus.filter(F.coalesce("dependent_count", F.lit(0)) >= min_dependents)
    bonus = scoring.blended_score(F.lit(0.0), F.col("dependent_count"), F.col("growth_pct"), weights)
    payload = ["name", "stars", "dependent_count", "growth_pct"]
    hits = vector_topk(
        used, queries, limit, threshold, payload=payload, bonus=bonus, weight=weights["similarity"]
    )
    return hits.select(
        "query_id", "rank", "name", name_key(F.col("name")).alias("name_key"),
        F.col("dependent_count").alias("dependents_count"), "stars", "growth_pct",
        F.col("score").alias("similarity_score"), F.col("order_score").alias("blended_score"),
    )


def hybrid_search(
    packages: DataFrame,
    corpus: DataFrame,
    queries: DataFrame,
    limit: int = 20,
    growth: Mapping[str, float] | None = None,
    semantic: Mapping[str, float] | None = None,
    text_col: str = "description",
) -> DataFrame:
    """Growth hits (for growth questions), then vector hits, then keyword hits.

    A package found twice keeps its first place; at most ``limit`` per query are returned.
    ``queries``: query_id, query, embedding.
    """
    columns = ["query_id", "name", "name_key", "dependents_count", "stars", "growth_pct", "rank"]

    def source(df: DataFrame, place: int, label: str) -> DataFrame:
        return df.select(
            *columns, F.lit(place).alias("source_rank"), F.lit(label).alias("source")
        )

    asking = query_intent(queries.select("query_id", "query")).filter("growth_intent_search")
    # `limit` rows at most: one small array, read by every growth question
    top = top_growth(packages, limit, **(growth or {})).select(
        F.struct(
            (-F.col("growth_score")).alias("order"), "name_key", "name", "dependents_count",
            "stars", "growth_pct",
        ).alias("r")
    )
    rising = top.agg(F.array_sort(F.collect_list("r"))).scalar()
    by_growth = asking.select("query_id", rising.alias("list")).select(
        "query_id", F.posexplode("list").alias("at", "r")
    ).select(
        "query_id", "r.name", "r.name_key", "r.dependents_count", "r.stars", "r.growth_pct",
        (F.col("at") + 1).alias("rank"),
    )
    by_vector = semantic_search(corpus, queries, limit, **(semantic or {}))
    by_word = keyword_search(
        packages, queries.select("query_id", F.col("query").alias("keyword")), limit, text_col
    )
    merged = (
        source(by_growth, 0, "growth")
        .unionByName(source(by_vector, 1, "semantic"))
        .unionByName(source(by_word, 2, "keyword"))
    )
    unique = dedupe_best(merged, ["query_id", "name_key"], [F.col("source_rank"), F.col("rank")])
    w = Window.partitionBy("query_id").orderBy("source_rank", "rank")
    return (
        unique.withColumn("pos", F.row_number().over(w))
        .filter(F.col("pos") <= limit)
        .drop("source_rank", "rank")
    )
