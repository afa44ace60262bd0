"""Keyed tables that are kept: new rows are appended as files, a numbered manifest commits them.

A table is a folder with ``data`` and ``manifests``. A commit writes new files first and then
creates the next manifest, which names the base files and the delta files over them; readers
take the newest manifest, so they see a commit whole or not at all. A manifest is put in place
by a rename that fails when the name is taken: of two writers one begins again on top of the
other. What a failed commit leaves are files that no manifest names.

Rows are merged when read: the newest row of a key wins, a tombstone removes it. Compaction
writes the merged rows as a new base, dealt by key buckets.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MARKS = T.StructType([T.StructField("_commit", T.LongType()), T.StructField("_gone", T.BooleanType())])


class CommitConflict(RuntimeError):
    """Other writers were faster in every attempt."""


@dataclass(frozen=True)
class Manifest:
    """The files of one version; ``last_batch`` is the highest batch number committed."""

    version: int = 0
    base: tuple[str, ...] = ()
    deltas: tuple[str, ...] = ()
    last_batch: int = -1
    rows: dict[str, int] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({
            "version": self.version, "base": self.base, "deltas": self.deltas, "last_batch": self.last_batch, "rows": self.rows,
        })

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        d = json.loads(text)
        return cls(d["version"], tuple(d["base"]), tuple(d["deltas"]), d["last_batch"], d["rows"])


class KeyedTable:
    """One row per key. ``schema`` holds the keys and the values; ``buckets`` is how a base is dealt."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], schema: T.StructType | str, buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.values = [c for c in self.schema.names if c not in self.keys]

    # --- manifests ---------------------------------------------------------------------------

    def _files(self):
        """The file system of the table's folder, and paths in it."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        conf = self.spark._jsc.hadoopConfiguration()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), conf)
        return root.getFileSystem(conf), context, lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        fs, _, path = self._files()
        folder = path("manifests")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """That version's manifest, the newest by default; an empty one before the first commit."""
        if version is None:
            known = self.versions()
            if not known:
                return Manifest()
            version = known[-1]
        text = self.spark.read.option("wholetext", "true").text(f"{self.path}/manifests/{version:012d}.json").first()[0]
        return Manifest.from_json(text)

    def _publish(self, manifest: Manifest) -> bool:
        """Put a manifest in place; False when its version is there already."""
        fs, context, path = self._files()
        draft = path("manifests", f".draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(manifest.to_json().encode()))
        out.close()
        target = path("manifests", f"{manifest.version:012d}.json")
        none = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        try:
            context.rename(draft, target, options)
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def _commit(self, change: Callable[[Manifest], Manifest | None], attempts: int = 20) -> Manifest:
        """Apply ``change`` to the newest manifest until it can be put in place; None leaves it."""
        for _ in range(attempts):
            old = self.manifest()
            new = change(old)
            if new is None:
                return old
            new = replace(new, version=old.version + 1)
            if self._publish(new):
                return new
        raise CommitConflict(self.path)

    # --- writing -----------------------------------------------------------------------------

    def _append(self, rows: DataFrame, batch: int) -> Manifest:
        if batch <= self.manifest().last_batch:
            return self.manifest()
        name = f"delta-{batch:012d}-{uuid.uuid4().hex}"
        rows.withColumn("_commit", F.lit(batch).cast("long")).write.parquet(f"{self.path}/data/{name}")

        def change(old: Manifest) -> Manifest | None:
            if batch <= old.last_batch:  # a replay, or another writer of the same batch
                return None
            return replace(old, deltas=(*old.deltas, name), last_batch=batch)

        return self._commit(change)

    def upsert(self, rows: DataFrame, batch: int) -> Manifest:
        """Add or replace rows by key. Batches are numbered upwards; one that is not above the last
        committed one changes nothing, so a replay is harmless. Of several rows of a key in one
        batch the largest counts (by the values in their order)."""
        best = F.max(F.struct(*[F.col(c) for c in self.values]))
        one = rows.groupBy(*self.keys).agg(best.alias("_v")).select(*self.keys, "_v.*") if self.values else rows.select(*self.keys).distinct()
        return self._append(one.select(*self.schema.names, F.lit(False).alias("_gone")), batch)

    def delete(self, keys: DataFrame, batch: int) -> Manifest:
        """Remove rows by key: tombstones, until the next compaction."""
        nulls = [F.lit(None).cast(self.schema[c].dataType).alias(c) for c in self.values]
        gone = keys.select(*self.keys).distinct().select(*self.keys, *nulls)
        return self._append(gone.select(*self.schema.names, F.lit(True).alias("_gone")), batch)

    def compact(self) -> Manifest:
        """Write the merged rows as the new base, by buckets of the key, and drop deltas and tombstones.

        Commits that come in meanwhile stay as deltas over the new base.
        """
        seen = self.manifest()
        if not seen.deltas:
            return seen
        name = f"base-{uuid.uuid4().hex}"
        merged = self._merged(seen).withColumns({"_commit": F.lit(seen.last_batch).cast("long"), "_gone": F.lit(False)})
        merged.repartition(self.buckets, *self.keys).sortWithinPartitions(*self.keys).write.parquet(f"{self.path}/data/{name}")

        def change(old: Manifest) -> Manifest | None:
            if old.base != seen.base or old.deltas[: len(seen.deltas)] != seen.deltas:
                return None  # another compaction was faster
            return replace(old, base=(name,), deltas=old.deltas[len(seen.deltas) :])

        return self._commit(change)

    # --- reading -----------------------------------------------------------------------------

    def _parts(self, names: Sequence[str]) -> DataFrame:
        schema = T.StructType([*self.schema.fields, *_MARKS.fields])
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{n}" for n in names])

    def _merged(self, manifest: Manifest) -> DataFrame:
        base = self._parts(manifest.base).select(*self.schema.names)
        if not manifest.deltas:
            return base
        deltas = self._parts(manifest.deltas)
        newest = deltas.groupBy(*self.keys).agg(
            F.max_by(F.struct("_gone", *self.values), "_commit").alias("_r")
        ).select(*self.keys, "_r.*")
        fresh = newest.filter("NOT _gone").select(*self.schema.names)
        if not manifest.base:
            return fresh
        # only the deltas are grouped; base rows are looked up by key, whatever they carry
        changed = deltas.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)]).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.keys)]
        return base.join(changed, same, "left_anti").unionByName(fresh)

    def read(self, version: int | None = None) -> DataFrame:
        """The table at that version, the newest by default."""
        return self._merged(self.manifest(version))
