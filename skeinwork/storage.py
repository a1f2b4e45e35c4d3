"""Intermediate tables in storage that every executor can read.

Iterative operators cut their lineage by writing a stage as Parquet and reading it
back.  The folder is the one the cluster names in ``spark.checkpoint.dir``; a lost
executor therefore never takes a stage with it.  A plain ``local[...]`` master without
that setting uses a private temporary folder; any other master must name one.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None


def _setting(spark: SparkSession, key: str) -> str | None:
    value = spark.conf.get(key, None)
    return value.rstrip("/") if value else None


def shared_root(spark: SparkSession) -> str:
    """Folder for intermediate tables, readable by every executor."""
    global _local_root
    root = _setting(spark, "spark.checkpoint.dir")
    if root:
        return root
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="skeinwork-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return _local_root


class Stash:
    """Stage tables of one operator call.

    ``put`` writes a DataFrame and returns it read back (short lineage, known size).
    ``drop`` removes stages that no later plan reads.  Stages the returned result
    still needs stay until the application ends, when the driver removes them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/skeinwork-{name}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self.close)

    def put(self, df: DataFrame, partitions: int | None = None) -> DataFrame:
        path = f"{self.base}/{self._n}"
        self._n += 1
        (df.coalesce(partitions) if partitions else df).write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._stash_path = path
        return back

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self._delete(getattr(df, "_stash_path", None))

    def keep_only(self, *frames: DataFrame) -> None:
        """Remove all stages but those of the given frames."""
        kept = {getattr(df, "_stash_path", None) for df in frames}
        for n in range(self._n):
            if f"{self.base}/{n}" not in kept:
                self._delete(f"{self.base}/{n}")

    def _delete(self, path: str | None) -> None:
        if not path:
            return
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def close(self) -> None:
        try:
            self._delete(self.base)
        except Exception:  # the session may be gone already at interpreter exit
            if self.base.startswith(("/", "file:")):
                shutil.rmtree(self.base.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def spread(spark: SparkSession, df: DataFrame, *cols) -> DataFrame:
    """Repartition over the session's shuffle width, for CPU-heavy work on few input files."""
    return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *cols)
