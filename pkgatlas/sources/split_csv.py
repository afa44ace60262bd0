"""Quoted CSV read in many tasks: a file is split at byte ranges, records are found by quote parity.

Whether a line begins inside a quoted field depends only on how many quotes stand before it. One
pass counts the quotes of each range; their running parity tells every range how it begins, so
each task finds its own records. A record that crosses a border leaves a piece in each range, and
only these pieces are put together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pkgatlas.session import materialize

#: Ranges whose parities are sent to the tasks, about 100 bytes each; beyond that they are joined.
SENT_RANGES = 500_000
_OUT = "file string, start long, opens boolean, closes boolean, record string"


def _quotes(value: Column) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, file, start, place): physical lines; ``start`` is the byte range's, ``place`` orders its lines."""
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"),
    )


class _Range:
    """The records of one byte range, line by line."""

    def __init__(self, file: str, start: int, inside: bool, header: bool) -> None:
        self.file, self.start, self.inside = file, start, inside
        self.cut = inside  # the first piece belongs to a record of an earlier range
        self.skip = header and start == 0
        self.held: list[str] = []
        self.rows: list[tuple] = []

    def _put(self, record: str, closes: bool) -> None:
        if self.skip:
            self.skip = False
        else:
            self.rows.append((self.file, self.start, not self.cut, closes, record))
        self.cut = False

    def lines(self, values: list[str], odd: list[bool]) -> None:
        for value, flips in zip(values, odd):
            self.inside ^= flips
            if self.inside:
                self.held.append(value)
            elif self.held:
                self._put("\n".join([*self.held, value]), True)
                self.held = []
            else:
                self._put(value, True)

    def end(self) -> None:
        if self.held:
            self._put("\n".join(self.held), False)
            self.held = []

    def drain(self) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
        columns = list(zip(*self.rows)) if self.rows else [()] * 5
        self.rows = []
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "start", "opens", "closes", "record"]
        )


def _plain_batch(now: _Range, records: pa.Array) -> pa.RecordBatch:
    n, yes = len(records), pa.scalar(True)
    return pa.RecordBatch.from_arrays([
        pa.repeat(pa.scalar(now.file, pa.string()), n), pa.repeat(pa.scalar(now.start, pa.int64()), n), pa.repeat(yes, n),
        pa.repeat(yes, n), records.cast(pa.string()),
    ], ["file", "start", "opens", "closes", "record"])


def _record_task(header: bool, plain_too: bool):
    """Records of ranges; lines outside quotes that hold whole records go by the batch, if ``plain_too``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Range | None = None
        for batch in batches:
            values, files, starts, inside = (batch.column(c) for c in range(4))
            odd = np.asarray(pc.count_substring(values, '"')) % 2 == 1
            starts_, files_ = starts.to_numpy(), files.dictionary_encode().indices.to_numpy()
            change = np.flatnonzero((np.diff(starts_) != 0) | (np.diff(files_) != 0)) + 1
            edges = [0, *change.tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                key = (files[a].as_py(), int(starts_[a]))
                if now is None or key != (now.file, now.start):
                    if now is not None:
                        now.end()
                        yield now.drain()
                    now = _Range(*key, inside[a].as_py(), header)
                part, flips = values.slice(a, b - a), odd[a:b]
                # a range's first record may be a header or the end of another range's
                at = 0
                while at < len(part) and (now.skip or now.cut):
                    now.lines([part[at].as_py()], [bool(flips[at])])
                    at += 1
                part, flips = part.slice(at), flips[at:]
                ends_inside = (np.cumsum(flips) + now.inside) % 2 == 1
                plain = ~ends_inside & ~np.concatenate([[now.inside], ends_inside])[:-1]
                if plain_too and plain.any():
                    yield _plain_batch(now, part.filter(pa.array(plain)))
                now.lines(part.filter(pa.array(~plain)).to_pylist(), flips[~plain].tolist())
            if now is not None:
                yield now.drain()
        if now is not None:
            now.end()
            yield now.drain()

    return run


def csv_records(spark: SparkSession, path: str | list[str], header: bool = True) -> DataFrame:
    """(record): the records of quoted CSV files, line breaks inside quotes included.

    Quotes stand around whole fields and are doubled inside them. A range is what Spark reads in
    one task (``spark.sql.files.maxPartitionBytes``). The last line of an open quote ends at the
    file's end. Blank records are dropped, as is each file's first one when it is a header.
    """
    lines = _lines(spark, path)
    per_range = lines.groupBy("file", "start").agg(F.sum(_quotes(F.col("value"))).alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range of a file
    parity = per_range.select(
        "file", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) % 2 == 1).alias("inside")
    )
    parity = materialize(parity, "quote-parity")
    if parity.count() <= SENT_RANGES:
        placed = lines.join(F.broadcast(parity), ["file", "start"])
    else:
        placed = lines.join(parity, ["file", "start"]).sortWithinPartitions("file", "start", "place")
    ranges = placed.select("value", "file", "start", "inside")
    whole = ranges.mapInArrow(_record_task(header, True), _OUT).filter("opens AND closes").select("record")
    # at most two pieces a range: the end of one record, the beginning of another
    cut = ranges.mapInArrow(_record_task(header, False), _OUT).filter("NOT (opens AND closes)")
    order = ["start", F.col("opens").cast("int")]
    number = F.sum(F.col("opens").cast("int")).over(Window.partitionBy("file").orderBy(*order))
    joined = (
        cut.withColumn("number", number)
        .groupBy("file", "number")
        .agg(F.array_sort(F.collect_list(F.struct("start", F.col("opens").cast("int").alias("o"), "record"))).alias("p"))
        .select(F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record"))
    )
    # a carriage return before the line feed belongs to the break
    record = F.regexp_replace("record", "\r$", "")
    return whole.unionByName(joined).select(record.alias("record")).filter(F.trim("record") != "")


def _parsed(spark: SparkSession, path, schema: T.StructType | str, options: dict[str, str]) -> DataFrame:
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    checked = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    how = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "escape": '"', "maxCharsPerColumn": "-1", **options}
    header = how.pop("header", "true").lower() == "true"
    return csv_records(spark, path, header).select("record", F.from_csv("record", checked.simpleString(), how).alias("r"))


def read_split_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str, **options: str) -> DataFrame:
    """As ``read_csv``, with as many tasks as a file has byte ranges.

    For files whose quotes stand around whole fields (RFC 4180); ``read_csv`` reads a lone quote
    inside a field as well, in one task a file.
    """
    return _parsed(spark, path, schema, options).filter("r._corrupt_record IS NULL").select("r.*").drop("_corrupt_record")


def rejected_split_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str, **options: str) -> DataFrame:
    """The records that ``read_split_csv`` skips, as they stand in the file: (record)."""
    return _parsed(spark, path, schema, options).filter("r._corrupt_record IS NOT NULL").select("record")
