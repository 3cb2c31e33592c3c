"""Tables that a plan writes once and reads many times, in the folder that driver and executors share.

The folder is ``spark.checkpoint.dir``; a local session without one gets a temporary folder. A written table cuts the
lineage, so plans stay small, and a lost executor costs a task.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="orderlens-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return "file://" + _own[0]


class Workspace:
    """The tables of one run."""

    def __init__(self, spark: SparkSession, label: str, inside: Workspace | None = None):
        self.spark, self.base = spark, f"{inside.base if inside else shared_folder(spark) + '/orderlens'}/{label}-{uuid.uuid4().hex}"

    def part(self, label: str) -> Workspace:
        """A workspace inside this one, which goes when this one is closed."""
        return Workspace(self.spark, label, self)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df, and read it back."""
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        """Remove the run's tables, once nothing reads them any more."""
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.base)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
