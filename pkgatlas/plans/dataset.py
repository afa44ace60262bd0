"""The build job: exports in, the stored package tables out, with a ledger of finished stages.

A stage reads exports or earlier stages and writes one Parquet folder. When it is written, a row goes
into the ledger, a kept table: the stage, a fingerprint, its folder, its row count. The fingerprint
covers the stage's settings, the names, sizes and times of the export files it reads and the
fingerprints of the stages it reads. A later run takes over every stage whose fingerprint stands in
the ledger and writes only the rest: after a failure it goes on behind the last finished stage,
after a new export it redoes what depends on it, and with nothing new it writes nothing.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgatlas import schemas
from pkgatlas.operators.build import build_packages
from pkgatlas.operators.lookup import Layers
from pkgatlas.sources.edge_index import EdgeIndex, write_edge_index
from pkgatlas.sources.files import ingest_platform
from pkgatlas.sources.split_csv import read_split_csv
from pkgatlas.sources.tables import KeyedTable

#: Raise it when a stage's code changes what it writes.
RECIPE = 1

DEPENDENTS = "package_name string, dependent_count long"
BRIDGE = "package_name string, repo string"
REPOS = "repo string, stars long, forks long, open_issues long, description string"

#: Schema of each export. Those of the fresh layer must be there, the others may be absent.
EXPORTS = {
    "dependents": DEPENDENTS,
    "bridge": BRIDGE,
    "repos": REPOS,
    "prior": DEPENDENTS,
    "projects": schemas.PROJECTS,
    "versions": schemas.VERSIONS,
    "deps": schemas.EDGES,
}
REQUIRED = ("dependents", "bridge", "repos")


@dataclass(frozen=True)
class Stage:
    """One stored table. ``write`` gets the paths of ``reads`` (exports or stages) and its own folder."""

    name: str
    reads: tuple[str, ...]
    settings: Mapping[str, object]
    write: Callable[[Mapping[str, str], str], None]


@dataclass(frozen=True)
class Dataset:
    """What a run left: folders by stage, the stages this run wrote, and the ledger."""

    spark: SparkSession
    folders: Mapping[str, str]
    written: tuple[str, ...]
    ledger: DataFrame

    def table(self, stage: str) -> DataFrame | None:
        """A stage's rows; None when its export was absent."""
        return self.spark.read.parquet(self.folders[stage]) if stage in self.folders else None

    def layers(self) -> Layers:
        return Layers(
            fresh=self.table("packages"), projects=self.table("projects"), deps=self.table("deps"), versions=self.table("versions")
        )

    def edge_index(self, on: str = "dependency_name") -> EdgeIndex | None:
        """The stored edges by ``on``; None without a ``deps`` export."""
        stage = f"edges_by_{on}"
        other = {"dependency_name": "project_name", "project_name": "dependency_name"}[on]
        return EdgeIndex(self.spark, self.folders[stage], other) if stage in self.folders else None


def _digest(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True).encode()).hexdigest()


def _listing(spark: SparkSession, path: str) -> list[list]:
    """(name, bytes, time) of every file under ``path``; names only, no content."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
    return sorted(found)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def package_stages(spark: SparkSession, exports: Mapping[str, str], platform: str) -> list[Stage]:
    """The stages for the exports at hand, each after those it reads."""

    def loaded(name: str, only: str | None) -> Stage:
        def write(paths: Mapping[str, str], folder: str) -> None:
            rows = read_split_csv(spark, paths[name], EXPORTS[name])
            (ingest_platform(rows, only) if only else rows).write.parquet(folder)

        table = name if only else f"staged_{name}"
        return Stage(table, (name,), {"schema": EXPORTS[name], "platform": only}, write)

    def packages(paths: Mapping[str, str], folder: str) -> None:
        rows = {t: spark.read.parquet(p) for t, p in paths.items()}
        build_packages(
            rows["staged_dependents"], rows["staged_bridge"], rows["staged_repos"], rows.get("staged_prior")
        ).write.parquet(folder)

    def indexed(on: str) -> Stage:
        def write(paths: Mapping[str, str], folder: str) -> None:
            write_edge_index(spark.read.parquet(paths["deps"]), folder, on)

        return Stage(f"edges_by_{on}", ("deps",), {"on": on}, write)

    fresh = [name for name in (*REQUIRED, "prior") if name in exports]
    stages = [loaded(name, None) for name in fresh]
    stages.append(Stage("packages", tuple(f"staged_{name}" for name in fresh), {}, packages))
    stages += [loaded(name, platform) for name in ("projects", "versions", "deps") if name in exports]
    if "deps" in exports:
        stages += [indexed("dependency_name"), indexed("project_name")]
    return stages


def build_dataset(spark: SparkSession, exports: Mapping[str, str], path: str, platform: str) -> Dataset:
    """Bring the tables under ``path`` up to date with ``exports`` (paths of CSV files or folders).

    Needs ``dependents``, ``bridge`` and ``repos``; ``prior``, ``projects``, ``versions`` and ``deps``
    are used where they are given. The last three keep the rows of ``platform``. Rows that do not
    fit their schema are skipped. An edge folder's count is that of its edges. Folders that no
    ledger row names are what a failed or older run left; nothing reads them.
    """
    missing, unknown = [n for n in REQUIRED if n not in exports], sorted(set(exports) - set(EXPORTS))
    if missing or unknown:
        raise ValueError(f"missing exports: {missing}, unknown exports: {unknown}")
    return run_stages(spark, package_stages(spark, exports, platform), exports, path)


def _row_count(spark: SparkSession, folder: str, stage: str) -> DataFrame:
    if stage.startswith("edges_by_"):  # its offsets know
        rows = spark.read.parquet(f"{folder}/offsets")
        return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"))
    return spark.read.parquet(folder).agg(F.count("*").alias("row_count"))


def run_stages(spark: SparkSession, stages: list[Stage], exports: Mapping[str, str], path: str) -> Dataset:
    """Write the stages that the ledger under ``path`` does not hold yet, in their order.

    A stage may carry the name of the export it loads; stages after it read the stage.
    """
    root = path.rstrip("/")
    ledger = KeyedTable(
        spark, f"{root}/ledger", ["stage"], "stage string, fingerprint string, folder string, row_count long", buckets=1
    )
    known = {r["stage"]: r for r in ledger.read().toLocalIterator()}  # a row per stage
    prints = {name: _digest(_listing(spark, p)) for name, p in exports.items()}
    folders, written = {}, []
    for stage in stages:
        prints[stage.name] = _digest([RECIPE, stage.name, dict(stage.settings), [[r, prints[r]] for r in stage.reads]])
        old = known.get(stage.name)
        if old and old["fingerprint"] == prints[stage.name] and _exists(spark, f"{root}/{old['folder']}"):
            folders[stage.name] = f"{root}/{old['folder']}"
            continue
        name = f"tables/{stage.name}-{uuid.uuid4().hex}"
        stage.write({r: folders.get(r) or exports[r] for r in stage.reads}, f"{root}/{name}")
        folders[stage.name] = f"{root}/{name}"
        row = _row_count(spark, folders[stage.name], stage.name).select(
            F.lit(stage.name).alias("stage"), F.lit(prints[stage.name]).alias("fingerprint"), F.lit(name).alias("folder"), "row_count"
        )
        while True:  # another run may have committed in between: go on top of it
            batch = ledger.manifest().last_batch + 1
            ledger.upsert(row, batch)
            if ledger.read().filter(F.col("folder") == name).head(1):
                break
        written.append(stage.name)
    current = ledger.read().filter(F.col("stage").isin(list(folders)))
    return Dataset(spark, folders, tuple(written), current)
