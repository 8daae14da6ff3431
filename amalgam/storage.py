"""Tables written to a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether the shuffle files of a query are removed when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors share.

    It is the one the session names in ``spark.checkpoint.dir``. Where that is unset a temporary folder serves a
    local master, whose executors run in this process; any other cluster has to name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="amalgam-")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/{spark.sparkContext.applicationId}"


#: Paths of the tables that were written within ``scratch``, by its name.
_scratch: dict[str, list[str]] = {}
_names: list[str] = []


@contextmanager
def scratch(name: str):
    """Tables written within it are those of ``name``, until ``release``."""
    _names.append(name)
    try:
        yield
    finally:
        _names.pop()


def release(spark: SparkSession, name: str) -> None:
    """Delete the tables of ``name`` that are still there. What reads them must have been written elsewhere."""
    for path in _scratch.pop(name, []):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def materialize(df: DataFrame, label: str, **options) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the lineage ends there, and a lost executor
    costs a read of that file instead of the steps before it. The shuffle files of those steps go at once. ``options``: of
    the writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._amalgam_path = path
    if _names:
        _scratch.setdefault(_names[-1], []).append(path)
    return back


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing will read again."""
    _delete(df.sparkSession, df._amalgam_path)


class SnapshotTable:
    """A table of Parquet snapshots: each write makes the next version, then moves a pointer to it.

    A write may read the current version, whose files it never touches; a failed write leaves the pointer where it was.
    ``keep`` old versions stay for readers that still use them.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 1):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The current version, 0 before the first write."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))] if self._fs.exists(self._path(self.path)) else []
        return max((int(n[8:]) for n in names if n.startswith("current=")), default=0)

    def exists(self) -> bool:
        return self.version() > 0

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v={self.version()}")

    def write(self, df: DataFrame, partition_by: tuple[str, ...] = ()) -> int:
        """Make ``df`` the next version."""
        now = self.version()
        target = self._path(f"{self.path}/v={now + 1}")
        self._fs.delete(target, True)  # left by a write that failed
        df.write.partitionBy(*partition_by).parquet(str(target.toString()))
        self._fs.mkdirs(self._path(f"{self.path}/current={now + 1}"))
        self._fs.delete(self._path(f"{self.path}/current={now}"), True)
        for old in range(now - self.keep, 0, -1):
            if not self._fs.delete(self._path(f"{self.path}/v={old}"), True):
                break
        return now + 1

    def upsert(self, source: DataFrame, how) -> int:
        """Write ``how(current, source)``, or ``source`` as the first version."""
        return self.write(how(self.read(), source) if self.exists() else source)
