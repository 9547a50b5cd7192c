"""The audit log: append-only, masked, partitioned by day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantseek.functions import text


def audit_rows(df: DataFrame) -> DataFrame:
    """Log rows as they are stored: secrets masked, long errors cut, the day added.

    ``detail`` is a map of strings or JSON text.
    """
    detail = F.col("detail")
    is_map = dict(df.dtypes)["detail"].startswith("map")
    out = {"detail": text.sanitize_detail(detail) if is_map else text.sanitize_json(detail),
           "day": F.to_date("created_at")}
    if "error" in df.columns:
        cut = F.substring("error", 1, 2000)
        out["error"] = F.when(F.length(cut) > 0, cut)
    return df.withColumns(out)


def append_audit(df: DataFrame, path: str) -> None:
    audit_rows(df).write.mode("append").partitionBy("day").parquet(path)
