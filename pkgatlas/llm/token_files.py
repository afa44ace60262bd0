"""Token-id files: documents in id order, range coded, and back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pkgatlas.llm import rans
from pkgatlas.llm.common import store, text_or_empty
from pkgatlas.llm.tokens import PieceEncoder

SEGMENT_IDS = 1 << 22
BLOCKS = "at long, docs array<long>, n_tokens array<long>, data binary"
SEGMENTS = "part int, segment int, n_ids long, docs array<long>, n_tokens array<long>, data binary"


def _segment_rows(part: int, number: int, docs: list, pieces: list[np.ndarray], block_ids: int) -> pa.RecordBatch:
    lengths = [len(p) for p in pieces]
    data = rans.encode(np.concatenate(pieces), rans.block_ends(lengths, block_ids))
    return pa.RecordBatch.from_arrays([
        pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([sum(lengths)], pa.int64()),
        pa.array([docs], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([data]),
    ], ["part", "segment", "n_ids", "docs", "n_tokens", "data"])


def _write_task(make: Callable[[str, int], PieceEncoder], path: str, end_id: int, segment_ids: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, number = make(path, end_id), TaskContext.get().partitionId(), 0
        docs, pieces, size = [], [], 0
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                docs.append(doc)
                pieces.append(ids)
                size += len(ids)
                if size >= segment_ids:
                    yield _segment_rows(part, number, docs, pieces, block_ids)
                    docs, pieces, size, number = [], [], 0, number + 1
        if docs:
            yield _segment_rows(part, number, docs, pieces, block_ids)

    return run


def write_token_files(
    docs: DataFrame,
    path: str,
    make_encoder: Callable[[str, int], PieceEncoder],
    tokenizer_path: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    segment_ids: int = SEGMENT_IDS,
    block_ids: int = rans.BLOCK_IDS,
) -> None:
    """Write ids of all documents to ``path``, ascending by id, as range-coded segments.

    Texts are dealt by ranges of the id and sorted, so files and the segments in them follow the
    id order; a segment closes after the document that brings it to ``segment_ids`` ids, a block at ``block_ids``. Each
    segment has a frequency table over all its ids, independent blocks of whole documents (a very
    long one has blocks of its own), checkpoints and checksums (see ``rans``); the container is Parquet, one row a segment, so any store that
    Spark writes to will do. Null or empty text is the end id alone. Null ids come first; rows
    with the same id keep their input order, and spread over tasks when they are many. Further
    columns are ignored; an empty table gives no segments.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc").asc_nulls_first(), F.col("tie")]
    (
        docs.select(
            F.col(id_col).cast("long").alias("doc"), text_or_empty(F.col(text_col)).cast("binary").alias("text"),
            F.monotonically_increasing_id().alias("tie"),
        )
        .repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .select("doc", "text")
        .mapInArrow(_write_task(make_encoder, tokenizer_path, end_id, segment_ids, block_ids), SEGMENTS)
        .write.option("compression", "none").parquet(path)
    )


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments cut by their checkpoints where a block and a document end together; nothing is decoded."""
    for batch in batches:
        for row in range(batch.num_rows):
            at, docs, lengths, data = (batch.column(c)[row].as_py() for c in range(4))
            segment = rans.Segment(data)
            doc_ends = np.cumsum(np.array(lengths, np.int64))
            block_ends = np.cumsum(segment.points["ids"].astype(np.int64))
            lasts = np.flatnonzero(np.isin(block_ends, doc_ends)) + 1
            doc = block = 0
            for last in lasts.tolist():
                end = int(np.searchsorted(doc_ends, block_ends[last - 1], "right"))
                yield pa.RecordBatch.from_arrays([
                    pa.array([at], pa.int64()), pa.array([docs[doc:end]], pa.list_(pa.int64())),
                    pa.array([lengths[doc:end]], pa.list_(pa.int64())), pa.array([segment.cut(block, last)], pa.binary()),
                ], ["at", "docs", "n_tokens", "data"])
                at += sum(lengths[doc:end])
                doc, block = end, last


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            at, docs, lengths, data = (batch.column(c)[row].as_py() for c in range(4))
            segment = rans.Segment(data)
            ids = segment.ids()
            ends = np.cumsum(np.array(lengths, np.int64))
            starts = ends - lengths
            for begin in range(0, len(docs), 2000):
                some = slice(begin, begin + 2000)
                yield pa.RecordBatch.from_arrays([
                    pa.array(docs[some], pa.int64()), pa.array(starts[some] + at), pa.array(lengths[some], pa.int64()),
                    pa.array([ids[a:b].tobytes() for a, b in zip(starts[some], ends[some])], pa.binary()),
                ], ["doc", "start", "n_tokens", "ids"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of token files: doc, start (ids before it), n_tokens, ids (unsigned 32-bit bytes).

    Checkpoints cut segments into blocks, which are dealt over the tasks still coded and decoded
    there, so files of any size and number decode in parallel; a document's blocks stay together.
    A damaged block raises an error. Starts are sums over one row per file, then over the segments
    of a file.
    """
    segments = spark.read.schema(SEGMENTS).parquet(path)
    sizes = segments.select("part", "segment", "n_ids")
    up_to = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    # one row per file
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("before")
    )
    starts, _ = store(
        sizes.withColumn("within", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
        .join(parts, "part").select("part", "segment", (F.col("before") + F.col("within")).alias("at")),
        "segment-starts",
    )
    # coded segments stay where they are when the starts are small, which their stored size tells
    blocks = segments.join(starts, ["part", "segment"]).select("at", "docs", "n_tokens", "data").mapInArrow(_split, BLOCKS)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(parts, "at").mapInArrow(_read, "doc long, start long, n_tokens long, ids binary")
