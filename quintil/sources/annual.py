"""Annual survey files and lookup tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANK_SCHEMA = "ANO4 int, {area} string, {name} double"


def scan_annual(
    spark: SparkSession,
    files: Mapping[str, str],
    schemas: T.StructType | str | Mapping[str, T.StructType | str] | None = None,
    nrows: int | None = None,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """One frame per configured year and their row and column counts.

    ``schemas`` is one schema, one per year, or None to read names from the
    header and infer types. ``nrows`` reads the first rows of every file only.
    """
    frames: dict[str, DataFrame] = {}
    for year, path in files.items():
        schema = schemas.get(year) if isinstance(schemas, Mapping) else schemas
        reader = spark.read.schema(schema) if schema is not None else spark.read.option("inferSchema", True)
        frame = reader.option("header", True).csv(path)
        frames[str(year)] = frame if nrows is None else frame.limit(nrows)
    return frames, annual_counts(frames)


def annual_counts(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and columns per year, as one job over the union of all years."""
    parts = [
        frame.groupBy().agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(year).alias("year"), "rows", F.lit(len(frame.columns)).alias("columns")
        )
        for year, frame in frames.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def scan_geo_ranks(spark: SparkSession, path: str, area: str, name: str) -> DataFrame:
    """Rank lookup by year and area."""
    return spark.read.schema(RANK_SCHEMA.format(area=area, name=name)).csv(path, header=True)
