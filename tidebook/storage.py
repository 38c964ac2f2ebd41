"""Where intermediate tables go: the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where it is absent, a temporary folder of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDERS:
        _OWN_FOLDERS[app] = "file://" + tempfile.mkdtemp(prefix="spark-tidebook-", dir="/tmp")
    return _OWN_FOLDERS[app]


def fresh_folder(spark: SparkSession, kind: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_folder(spark)}/{kind}/{uuid.uuid4().hex}"


def cut(df: DataFrame, kind: str = "tables") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so a lost executor costs no recomputation."""
    folder = fresh_folder(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
