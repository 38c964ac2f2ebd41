"""Helpers that the operators share: cutting lineage, naming and text columns."""

from __future__ import annotations

import re

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.storage import cut, fresh_folder, shared_folder

__all__ = ["bounded_batches", "cut", "fresh_folder", "is_held_out", "place_of", "read_table", "shared_folder", "shuffle_partitions"]

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Python workers get at most ``rows`` texts at a time, unless the session asks for fewer: whole
    documents in the default batches of 10,000 rows take much of a small executor."""
    if int(spark.conf.get(_BATCH)) > rows or int(spark.conf.get(_BATCH)) <= 0:
        spark.conf.set(_BATCH, str(rows))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, to be read in bounded batches."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder that tasks open themselves."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))  # the same store under Spark's names


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def is_held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the fold that no classifier learns from: crc32 of the id's text, modulo ``folds``, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))
