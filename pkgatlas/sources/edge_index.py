"""Stored dependency edges that answer "the first n, or all, of a name" without sorting again.

Edges are dealt to parts by ranges of (name, the shown columns), one folder each, and sorted there,
so a name that a third of all edges hold lies in many parts. Every row carries its running number;
a small table of offsets tells for each (name, part) where the name begins and how many of its edges
lie in parts before. A row's position is then a subtraction: no window, no task that holds a name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pkgatlas.functions.names import name_key

#: Equal edges that stay together until after the shuffle; a part holds at most so many times its share.
COPIES_PER_ROW = 16
#: Rows that one row of counts becomes in a step.
ROWS_PER_STEP = 4096

_SHOWN = ("dependency_kind", "dependency_requirements")


@dataclass(frozen=True)
class EdgeIndex:
    """An index that ``write_edge_index`` wrote: edges of each ``on`` name, listed by ``other``."""

    spark: SparkSession
    path: str
    other: str

    def _edges(self) -> DataFrame:
        schema = f"name_key string, {self.other} string, {', '.join(f'{c} string' for c in _SHOWN)}, row long, part int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/edges")

    def offsets(self) -> DataFrame:
        """(name_key, part, first, n, before): a row for each part that a name's edges reach."""
        schema = "name_key string, part int, first long, n long, before long"
        return self.spark.read.schema(schema).parquet(f"{self.path}/offsets")

    def counts(self) -> DataFrame:
        """(name_key, edge_count), from the offsets alone."""
        return self.offsets().groupBy("name_key").agg(F.sum("n").alias("edge_count"))

    def listed(self, asked: DataFrame, limit: int = 50) -> DataFrame:
        """The first ``limit`` edges of each row of ``asked`` (name, name_key); 0 means all.

        Only parts that hold an answer are read when the list is short enough to broadcast; a
        longer one is shuffled by (part, name), of which a hot name has many.
        """
        spots = self.offsets().filter(F.col("n") > 0)
        if limit > 0:
            spots = spots.filter(F.col("before") < limit)
        rows = self._edges().join(asked.join(spots, "name_key"), ["part", "name_key"])
        rows = rows.withColumn("pos", F.col("row") - F.col("first") + F.col("before") + 1)
        if limit > 0:
            rows = rows.filter(F.col("pos") <= limit)
        return rows.select("name", "name_key", F.col("pos").cast("int").alias("pos"), self.other, *_SHOWN)


def write_edge_index(edges: DataFrame, path: str, on: str = "dependency_name", parts: int | None = None) -> EdgeIndex:
    """Write ``edges`` to ``path`` (a new folder) for lookups by ``on``; edges without that name are left out.

    ``parts`` is the number of ranges, the session's shuffle partitions by default. Equal edges are
    counted map-side first and travel as counts, in chunks that ranges can tell apart, so neither a
    hot name nor a hot edge fills one part. The offsets are written last: an index whose write was
    cut short cannot be opened by mistake.
    """
    other = {"dependency_name": "project_name", "project_name": "dependency_name"}[on]
    spark, columns = edges.sparkSession, ["name_key", other, *_SHOWN]
    counted = (
        edges.filter(F.col(on).isNotNull())
        .select(name_key(F.col(on)).alias("name_key"), other, *_SHOWN)
        .groupBy(*columns).agg(F.count("*").alias("copies"))
    )
    chunk, step = F.col("chunk"), F.col("step")
    last_step = F.floor((F.col("copies") - 1) / (COPIES_PER_ROW * ROWS_PER_STEP))
    last_chunk = F.floor((F.col("copies") - 1) / COPIES_PER_ROW)
    chunks = counted.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), last_step))).withColumn(
        "chunk", F.explode(F.sequence(step * ROWS_PER_STEP, F.least((step + 1) * ROWS_PER_STEP - 1, last_chunk)))
    )
    in_chunk = F.least(F.lit(COPIES_PER_ROW), F.col("copies") - chunk * COPIES_PER_ROW).cast("int")
    order = [*columns, "chunk"]
    ranged = chunks.repartitionByRange(parts, *order) if parts else chunks.repartitionByRange(*order)
    rows = (
        ranged.withColumn("_copy", F.explode(F.sequence(F.lit(1), in_chunk)))
        .withColumn("part", F.spark_partition_id())
        .sortWithinPartitions("part", *order)
        .select(*columns, F.monotonically_increasing_id().alias("row"), "part")
    )
    rows.write.partitionBy("part").parquet(f"{path}/edges")
    index = EdgeIndex(spark, path, other)
    reached = index._edges().groupBy("name_key", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("name_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = reached.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")))
    offsets.sortWithinPartitions("name_key", "part").write.parquet(f"{path}/offsets")
    return index
