"""The package tables, derived from the star-schema test tables.

Whole tables throughout. ``plans/oracle.py`` states the same views in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgatlas.functions.names import explode_name_list
from pkgatlas.operators.build import build_packages
from pkgatlas.operators.lookup import Layers
from pkgatlas.operators.trends import latest_downloads, monthly_downloads
from pkgatlas.session import materialize
from pkgatlas.sources.files import ingest_platform

AS_OF = "2001-12-31"


def pkg(number: Column) -> Column:
    """Package name of a number; some spellings are mixed case."""
    text = number.cast("string")
    return F.concat(F.when(F.contains(text, F.lit("1")), "Pkg-").otherwise("pkg-"), text)


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


class Domain:
    """Lazy views over one data folder."""

    def __init__(
        self, spark: SparkSession, sf_dir: str, stored_packages: DataFrame | None = None
    ) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._packages = stored_packages

    def stored(self) -> Domain:
        """The same views over a ``packages`` table written once, for answers that read it
        several times."""
        return Domain(self.spark, self.sf_dir, materialize(self.packages(), "packages"))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # staging
    def _dependents(self, low: str, high: str | None) -> DataFrame:
        rows = self.table("lineitem").filter(F.col("l_shipdate") >= ntz(low))
        if high:
            rows = rows.filter(F.col("l_shipdate") < ntz(high))
        counts = rows.groupBy("l_partkey").agg(F.count("*").alias("dependent_count"))
        return counts.select(pkg(F.col("l_partkey")).alias("package_name"), "dependent_count")

    def dependents(self) -> DataFrame:
        return self._dependents("2000-01-01", None)

    def prior(self) -> DataFrame:
        return self._dependents("1998-01-01", "2000-01-01")

    def bridge(self) -> DataFrame:
        return self.table("lineitem").select(
            pkg(F.col("l_partkey")).alias("package_name"),
            F.concat(F.lit("org/repo-"), F.col("l_suppkey").cast("string")).alias("repo"),
        )

    def repos(self) -> DataFrame:
        return self.table("supplier").select(
            F.concat(F.lit("org/repo-"), F.col("s_suppkey").cast("string")).alias("repo"),
            F.greatest(F.col("s_acctbal").cast("long"), F.lit(0).cast("long")).alias("stars"),
            F.col("s_nationkey").cast("long").alias("forks"),
            F.length("s_name").cast("long").alias("open_issues"),
            F.col("s_name").alias("description"),
        )

    # layers
    def staged_packages(self) -> DataFrame:
        return build_packages(self.dependents(), self.bridge(), self.repos(), self.prior())

    def packages(self) -> DataFrame:
        """Packages with a description of their own."""
        if self._packages is not None:
            return self._packages
        texts = self.table("part").select(
            F.lower(pkg(F.col("p_partkey"))).alias("name_key"),
            F.concat_ws(
                " ", "p_name", F.lower("p_type"), F.lit("package for"), "p_brand"
            ).alias("_text"),
        )
        staged = self.staged_packages()
        return staged.join(texts, "name_key", "left").select(
            *[
                F.coalesce("_text", "description").alias("description") if c == "description" else c
                for c in staged.columns
            ]
        )

    def all_projects(self) -> DataFrame:
        o = self.table("orders")
        number = F.col("o_orderkey").cast("string")
        return o.select(
            F.concat(
                F.when(F.col("o_orderpriority") == "1-URGENT", "PKG-").otherwise("pkg-"), number
            ).alias("name"),
            F.concat("o_orderpriority", F.lit(" project of customer "), F.col("o_custkey").cast("string")).alias("description"),
            F.col("o_totalprice").cast("long").alias("stars"),
            F.col("o_custkey").alias("forks"),
            (F.col("o_totalprice") / 1000).cast("long").alias("dependents_count"),
            F.concat(
                F.lit("https://git.example.org/c"), F.col("o_custkey").cast("string"),
                F.lit("/p"), number, F.lit("/"),
            ).alias("repository_url"),
            F.col("o_orderpriority").alias("licenses"),
            F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("latest_release_ts"),
            F.col("o_orderstatus").alias("platform"),
        )

    def projects(self) -> DataFrame:
        return ingest_platform(self.all_projects(), "O")

    def all_deps(self) -> DataFrame:
        dependency = F.when(
            F.col("l_returnflag") == "R", F.concat(F.lit("PKG-"), F.col("l_partkey").cast("string"))
        ).otherwise(pkg(F.col("l_partkey")))
        return self.table("lineitem").select(
            F.concat(F.lit("pkg-"), F.col("l_orderkey").cast("string")).alias("project_name"),
            dependency.alias("dependency_name"),
            F.col("l_returnflag").alias("dependency_kind"),
            F.concat(F.lit(">="), F.col("l_linenumber").cast("string")).alias(
                "dependency_requirements"
            ),
            F.col("l_linestatus").alias("platform"),
        )

    def deps(self) -> DataFrame:
        return ingest_platform(self.all_deps(), "O")

    def versions(self) -> DataFrame:
        rows = self.table("events").select(
            F.concat(F.lit("pkg-"), F.col("user_id").cast("string")).alias("project_name"),
            F.col("event_type").alias("platform"),
        )
        return ingest_platform(rows, "signup")

    def metadata(self) -> DataFrame:
        d = self.table("documents")
        name, chars = pkg(F.col("doc_id")), F.col("n_chars").cast("string")
        code = (
            F.when(
                F.col("lang") == "en",
                F.concat(
                    F.lit("\n```bash\npip install x\n```\n\n```python\nimport "), "source",
                    F.lit("\nrun("), chars, F.lit(")\n```\n"),
                ),
            )
            .when(F.col("lang") == "fr", F.concat(F.lit("\n```\nx = "), chars, F.lit("\n```\n")))
            .when(
                F.col("lang") == "de",
                F.concat(
                    F.lit("\n\n    value = f("), chars, F.lit(")\n    print(value)\n\nEnd."),
                ),
            )
            .otherwise("")
        )
        date = F.date_sub(F.to_date(F.lit(AS_OF)), F.floor(F.col("n_chars") / 10).cast("int"))
        return d.select(
            name.alias("name"),
            F.concat(
                F.lit("A "), "lang", F.lit(" library from "), "source",
                F.when(F.col("n_chars") > 2000, " for machine learning")
                .when(F.col("lang") == "de", " with vector search")
                .otherwise(""),
            ).alias("summary"),
            F.concat("text", code).alias("readme"),
            F.concat_ws(",", "lang", "source").alias("keywords"),
            F.concat(
                F.lit('["Language :: '), "lang", F.lit('","Source :: '), "source", F.lit('"]')
            ).alias("classifiers"),
            F.concat(F.lit("1."), chars).alias("version"),
            F.col("source").alias("author"),
            F.col("lang").alias("license"),
            F.concat(
                F.lit('["pkg-'), chars, F.lit(' (>=1.0)","Pkg_'), F.col("doc_id").cast("string"),
                F.lit("[fast,x]>=2,<3; extra == 'x'\"]"),
            ).alias("requires_dist"),
            F.lit(">=3.8").alias("requires_python"),
            F.floor(F.col("n_chars") / 100).cast("long").alias("total_versions"),
            F.when(F.col("source") == "src3", "unknown")
            .when(F.col("source") == "src5", "")
            .otherwise(F.date_format(date, "yyyy-MM-dd"))
            .alias("latest_release_date"),
            F.lit("").alias("first_release_date"),
            F.concat(F.lit("https://"), "source", F.lit(".example.org")).alias("home_page"),
        )

    def downloads(self) -> DataFrame:
        return self.table("lineitem").select(
            pkg(F.col("l_partkey")).alias("package_name"),
            F.date_format("l_shipdate", "yyyy-MM-dd").alias("month"),
            F.col("l_quantity").cast("long").alias("downloads"),
        )

    def brand_downloads(self) -> DataFrame:
        """Downloads under the 25 brand names, for tables with one column per name."""
        part = self.table("part").select("p_partkey", "p_brand")
        return (
            self.table("lineitem")
            .join(part, F.col("l_partkey") == F.col("p_partkey"))
            .select(
                F.col("p_brand").alias("package_name"),
                F.date_format("l_shipdate", "yyyy-MM-dd").alias("month"),
                F.col("l_quantity").cast("long").alias("downloads"),
            )
        )

    def latest(self) -> DataFrame:
        return latest_downloads(monthly_downloads(self.downloads()))

    def layers(self) -> Layers:
        return Layers(
            fresh=self.packages(), projects=self.projects(), deps=self.deps(),
            versions=self.versions(), metadata=self.metadata(), downloads=self.downloads(),
        )

    # requests
    def request_texts(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("request_id"),
            F.concat(
                F.lit("pkg-"), F.col("o_custkey").cast("string"),
                F.lit(", PKG-"), F.col("o_orderkey").cast("string"),
                F.lit(",, pkg-"), F.dayofyear("o_orderdate").cast("string"),
            ).alias("packages"),
        )

    def requests(self) -> DataFrame:
        return explode_name_list(self.request_texts(), "packages", min_names=2)

    def names(self) -> DataFrame:
        return self.requests().select("name").distinct()

    # vectors
    def vectors(self) -> DataFrame:
        e = self.table("embeddings").select(
            F.col("vec_id").alias("id"), "embedding",
            pkg(F.col("vec_id")).alias("name"), F.lower(pkg(F.col("vec_id"))).alias("name_key"),
        )
        p = self.packages().select("name_key", "stars", "dependent_count", "growth_pct")
        m = self.metadata().select(F.lower("name").alias("name_key"), "summary", "version")
        return (
            e.join(p, "name_key", "left")
            .join(m, "name_key", "left")
            .select("id", "embedding", "name", "summary", "stars", "dependent_count", "growth_pct", "version")
        )

    def topics(self) -> DataFrame:
        """One search question per label: its mean vector and a product text."""
        means = (
            self.table("embeddings")
            .select(F.col("label").alias("query_id"), F.posexplode("embedding").alias("i", "v"))
            .groupBy("query_id", "i")
            .agg(F.avg("v").alias("v"))
            .groupBy("query_id")
            .agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("pairs"))
            .select("query_id", F.col("pairs.v").alias("embedding"))
        )
        texts = self.table("part").groupBy("p_brand").agg(
            F.when(F.avg("p_size") > 25.5, F.concat(F.lit("trending "), F.min("p_name")))
            .otherwise(F.min("p_name"))
            .alias("query")
        )
        brand = F.concat(F.lit("Brand#"), (F.col("query_id") + 1).cast("string"))
        return means.join(texts, brand == F.col("p_brand")).select("query_id", "query", "embedding")

    # questions
    def asked_questions(self) -> DataFrame:
        return self._questions(F.col("role") == "user")

    def known_questions(self) -> DataFrame:
        return self._questions(F.lit(True))

    def _questions(self, wanted: Column) -> DataFrame:
        return self.table("conversations").filter(wanted).select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
            F.col("text").alias("query"),
            _mode(F.col("text")).alias("mode"),
        )


def _mode(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("?")), "compare").otherwise("explore")
