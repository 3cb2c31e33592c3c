"""Result store: Parquet tables of runs, committed together by one manifest.

A commit stages the rows of all its tables in new folders and then puts one manifest in place by a rename that refuses an
existing name. Readers resolve the tables through the newest manifest, so they see all tables of a run or none of them, and
a run that died before its rename left nothing but folders that `vacuum` removes. A commit that finds its manifest's number
taken reads the newer manifest and joins its rows with that one's.

A manifest is a small JSON file: of each table, the folder of each run date.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

KEYS = ["customer", "material_group"]
ATTEMPTS = 10


def write_run(results: DataFrame, path: str, run_date: str) -> None:
    """Replace one run's partition; other runs stay untouched."""
    results.withColumn("run_date", F.lit(run_date)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def latest_run(runs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Each segment's rows of its latest run."""
    newest = F.max("run_date").over(Window.partitionBy(*keys))
    return runs.withColumn("_newest", newest).where("run_date = _newest").drop("_newest")


def not_done(segments: DataFrame, runs: DataFrame, run_date: str, keys: list[str] = KEYS) -> DataFrame:
    """Segments that the run has not stored yet."""
    return segments.join(runs.where(F.col("run_date") == run_date).select(*keys), keys, "left_anti")


def upsert(runs: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The runs with the new rows in place of those with their keys."""
    return runs.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


class Store:
    """The committed tables under one folder, of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self._files.listStatus(at)) if self._files.exists(at) else []

    def versions(self) -> list[int]:
        """Numbers of the manifests, oldest first."""
        return [int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> tuple[int, dict[str, dict[str, str]]]:
        """The number and contents {table: {run date: folder}} of a manifest, the newest if none is named; 0 for an empty store."""
        known = self.versions()
        version = version if version is not None else known[-1] if known else 0
        if not version:
            return 0, {}
        text = self.spark.read.text(f"{self.folder}/manifests/{version:012d}.json", wholetext=True).first()[0]
        return version, json.loads(text)

    def table(self, name: str, version: int | None = None) -> DataFrame | None:
        """A table's rows of all runs with their `run_date`; None if nothing was committed yet. Older versions stay readable."""
        folders = self.manifest(version)[1].get(name)
        return self.spark.read.parquet(*(f"{self.folder}/{f}" for _, f in sorted(folders.items()))) if folders else None

    def _put(self, version: int, tables: dict[str, dict[str, str]]) -> bool:
        """Put the manifest in place; False if another commit has taken the number."""
        self._files.mkdirs(self._path("manifests"))
        aside = self._path(f"manifests/_{uuid.uuid4().hex}")
        out = self._files.create(aside, False)
        out.write(bytearray(json.dumps(tables, sort_keys=True).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), self._conf)
        plain = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)  # never over a file
        try:
            context.rename(aside, self._path(f"manifests/{version:012d}.json"), plain)
        except Py4JJavaError as error:
            self._files.delete(aside, False)
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            return False
        return True

    def commit(self, tables: dict[str, DataFrame], run_date: str, keys: list[str] = KEYS, replace: Callable[[str], bool] = lambda name: False) -> int:
        """Store rows of a run in all the tables, or in none; returns the manifest's number.

        Rows of the same run with the new rows' keys are replaced, all others stay; where `replace(table)` holds, the new
        rows take the place of the whole run.
        """
        staged = {}
        for name, new in tables.items():
            staged[name] = f"data/{name}/{uuid.uuid4().hex}"
            new.withColumn("run_date", F.lit(run_date)).write.parquet(f"{self.folder}/{staged[name]}")
        for _ in range(ATTEMPTS):
            version, known = self.manifest()
            after = {name: dict(runs) for name, runs in known.items()}
            for name, folder in staged.items():
                old = after.setdefault(name, {}).get(run_date)
                after[name][run_date] = folder if old is None or replace(name) else self._joined(name, old, folder, keys)
            if self._put(version + 1, after):
                return version + 1
        raise RuntimeError(f"{ATTEMPTS} other commits came first")

    def _joined(self, name: str, old: str, new: str, keys: list[str]) -> str:
        """A folder with the old rows of a run, those with the new rows' keys replaced."""
        both = f"data/{name}/{uuid.uuid4().hex}"
        read = lambda f: self.spark.read.parquet(f"{self.folder}/{f}")
        upsert(read(old), read(new), keys).write.parquet(f"{self.folder}/{both}")
        return both

    def vacuum(self, keep: int = 1) -> int:
        """Remove all but the newest `keep` manifests, and folders that none of these names; returns the folders removed.

        Not while a commit is under way: its staged folders are in no manifest yet.
        """
        kept = self.versions()[-keep:]
        named = {folder for v in kept for runs in self.manifest(v)[1].values() for folder in runs.values()}
        for name in self._names("manifests"):
            if not name.endswith(".json") or int(name.removesuffix(".json")) not in kept:
                self._files.delete(self._path(f"manifests/{name}"), False)
        stray = [f"data/{t}/{x}" for t in self._names("data") for x in self._names(f"data/{t}") if f"data/{t}/{x}" not in named]
        for folder in stray:
            self._files.delete(self._path(folder), True)
        return len(stray)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """One of the store's tables; None if nothing was committed yet."""
    return Store(spark, folder).table(name)
