"""The folder that all executors share, and tables written there and read again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_STAGED: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only where that is unset and the master is local, as in tests on one machine, a temporary
    folder is made and set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lumenquarry-")
        spark.conf.set("spark.checkpoint.dir", at)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing has; what is there goes when the process ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _STAGED[path] = spark
    return path


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage in a way that survives lost executors, and gives Catalyst the
    true size, so that it broadcasts the table in a join only where it is small.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``staged`` wrote for this very DataFrame, if it did."""
    path = getattr(df, "_staged_at", None)
    if path in _STAGED:
        _delete(_STAGED.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _drop() -> None:
    for path, spark in _STAGED.items():
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone by now
            return
