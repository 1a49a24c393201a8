"""Intermediate tables that outlive the executors that wrote them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: str | None = None
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset (tests, one
    machine), a temporary folder that is removed when the process ends."""
    global _local
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local is None:
        _local = tempfile.mkdtemp(prefix="quillwork-")
        atexit.register(shutil.rmtree, _local, True)
    return f"file://{_local}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back.

    Cuts the lineage: later stages read the files, whichever executors are lost.
    The files stay until discard or the end of the driver's process.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(_remove_all)
    _written[path] = df.sparkSession
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _remove_all() -> None:
    for path, spark in list(_written.items()):
        try:
            _remove(spark, path)
        except Exception:  # the session may be gone by now
            return


def discard(*tables: DataFrame) -> None:
    """Removes tables that materialize returned, once no plan needs them any more."""
    for df in tables:
        path = getattr(df, "_table_path", None)
        if path in _written:
            _remove(_written.pop(path), path)
