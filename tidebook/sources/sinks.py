"""Writers of result tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_result(rows: DataFrame, path: str, csv: bool = False, by: list[str] | None = None) -> None:
    """A result table as zstd Parquet at ``path``.parquet and, if asked, CSV with a header at ``path``.csv."""
    out = rows.write.mode("overwrite").option("compression", "zstd")
    (out.partitionBy(*by) if by else out).parquet(f"{path}.parquet")
    if csv:
        flat = rows.select(*(F.to_json(c).alias(c) if kind.startswith(("array", "map", "struct")) else F.col(c) for c, kind in rows.dtypes))
        flat.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{path}.csv")


def write_csv_if_any(rows: DataFrame, path: str) -> bool:
    """CSV of a result, only if it has a row."""
    if rows.isEmpty():
        return False
    rows.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)
    return True


def write_reports(rows: DataFrame, path: str) -> None:
    """JSON lines, one object per report row, by date where there is one."""
    out = rows.write.mode("overwrite")
    (out.partitionBy("date") if "date" in rows.columns else out).json(path)


def _normal(path: str) -> str:
    return re.sub(r"^file:/+", "/", path).rstrip("/") + "/"


def write_healed(rows: DataFrame, source: str, target: str) -> None:
    """Healed snapshots below another root, in the folders of their original hour; never over the source, nor
    inside or around any file that ``rows`` are read from."""
    out = _normal(f"{target}/snapshots")
    # the folders of the tables that the files belong to, above their partitions
    read = {_normal(source), *(_normal(re.sub(r"/([^/=]+=[^/]*/.*|[^/]*)$", "", f)) for f in rows.inputFiles())}
    if _normal(target) == _normal(source) or any(out.startswith(r) or r.startswith(out) for r in read):
        raise ValueError("healed snapshots go to another root than their source")
    rows.repartition("symbol", "date", "hour").write.mode("overwrite").partitionBy("symbol", "date", "hour").option("compression", "zstd").parquet(f"{target}/snapshots")
