"""Results as text, JSON, tables and bare paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMATS = ("text", "json", "csv", "paths", "nul")


def _quoted(c: str) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), '"', '""'), F.lit('"'))


def rendered(hits: DataFrame, kind: str) -> DataFrame:
    """One string per hit, in the hits' order: (line)."""
    if kind == "json":
        return hits.select(F.to_json(F.struct(*hits.columns)).alias("line"))
    if kind == "csv":
        wanted = [c for c in ("path", "kind", "size", "mtime", "count") if c in hits.columns]
        return hits.select(F.concat_ws(",", *[_quoted(c) for c in wanted]).alias("line"))
    if kind == "nul":
        return hits.select(F.concat("path", F.lit("\0")).alias("line"))
    if kind in ("paths", "text"):
        return hits.select(F.col("path").alias("line"))
    raise ValueError(f"format must be one of {', '.join(FORMATS)}")


def write(hits: DataFrame, folder: str, kind: str) -> None:
    """To a folder, in as many files as the plan has partitions."""
    if kind == "csv":
        hits.write.mode("overwrite").option("quoteAll", True).option("header", True).csv(folder)
    elif kind == "json":
        hits.write.mode("overwrite").json(folder)
    else:
        rendered(hits, kind).write.mode("overwrite").text(folder)
