"""Where intermediate tables live.

Long plans are cut by writing a table into the shared folder the cluster names
in ``spark.checkpoint.dir`` (never a machine-local folder on a cluster, never
localCheckpoint), so that a lost executor costs a re-read and not the lineage.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own only where it is unset (tests, local mode)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="docmill-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as a table in the shared folder and return the table read again: cuts lineage and runs the plan once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docmill-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    atexit.register(_remove, spark, path)
    return out


def release(written: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing reads any more, such as the last but one round of an iteration."""
    if path := getattr(written, "_written", None):
        _remove(written.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        if "://" not in path or path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
        else:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone; the folder's owner cleans up then
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
