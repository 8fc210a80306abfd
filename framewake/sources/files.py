"""CSV sidecars, GeoJSON sequences and JSON reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: the fixed columns of a CSV sidecar
CSV_SCHEMA = T.StructType(
    [T.StructField("TimeStamp", T.LongType()), T.StructField("LDSVer", T.IntegerType())]
    + [T.StructField(n, T.DoubleType()) for n in ("PlatformHeading", "PlatformPitch", "PlatformRoll")]
    + [T.StructField("PlatformTrueAirSpeed", T.IntegerType())]
    + [T.StructField(n, T.DoubleType()) for n in ("SensorLatitude", "SensorLongitude", "SensorAltitude", "HorizontalFOV", "VerticalFOV", "SensorRelativeAzimuth", "SensorRelativeElevation", "SensorRelativeRoll")]
)


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV sidecars by their header: blank cells are null, other columns are ignored, issue says what a row lacks."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    cells = {f.name: F.nullif(F.trim(F.col(f"`{f.name}`")), F.lit("")) if f.name in raw.columns else F.lit(None).cast("string") for f in CSV_SCHEMA}
    typed = {f.name: cells[f.name].try_cast(f.dataType) for f in CSV_SCHEMA}
    wrong = F.array_compact(F.array(*[F.when(cells[n].isNotNull() & typed[n].isNull(), n) for n in cells]))
    issue = F.when(cells["TimeStamp"].isNull(), "no TimeStamp").when(F.size(wrong) > 0, F.concat(F.lit("not a number: "), F.array_join(wrong, ", ")))
    return raw.select(*[v.alias(n) for n, v in typed.items()], issue.alias("issue"))


def write_sidecar(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write rows under the fixed columns; nulls become empty cells. Refuses to replace files unless told to."""
    have = {c.lower(): c for c in df.columns}
    columns = [F.col(have[f.name.lower()]).cast(f.dataType).alias(f.name) if f.name.lower() in have else F.lit(None).cast(f.dataType).alias(f.name) for f in CSV_SCHEMA]
    df.select(*columns).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("emptyValue", "").csv(path)


def feature(geometry: Column, properties: Column) -> Column:
    return F.when(geometry.isNotNull(), F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))


def feature_collections(df: DataFrame, features: Column) -> DataFrame:
    """A line for each row: a FeatureCollection of its features; missing ones are left out."""
    return df.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array_compact(features).alias("features"))).alias("value"))


def write_sequence(df: DataFrame, features: Column, path: str, overwrite: bool = False) -> None:
    """Write feature collections, one a line."""
    feature_collections(df, features).write.mode("overwrite" if overwrite else "errorifexists").text(path)
