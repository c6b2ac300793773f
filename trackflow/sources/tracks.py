"""Readers of fixes and gate lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackflow.sources import geopackage


def read_tracks(spark: SparkSession, path: str, fmt: str = "gpkg") -> DataFrame:
    """Raw fixes of a folder with source_file and source_layer on every row.

    GeoPackage folders give both from the file and layer names. In columnar
    folders source_file is the file's name where the data does not carry it.
    """
    if fmt == "gpkg":
        geopackage.register(spark)
        return spark.read.format(geopackage.GeoPackageSource.name()).load(path)
    found = spark.read.format(fmt).load(path)
    if "source_file" not in found.columns:
        found = found.withColumn("source_file", F.col("_metadata.file_name"))
    return found


def append_by_name(parts: list[DataFrame]) -> DataFrame:
    """Appends tables by column name; a column a table lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_gates(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Gate lines drawn elsewhere: (route, gate_no, x1, y1, x2, y2) in grid metres, not transformed."""
    gates = spark.read.format(fmt).options(**({"header": "true", "inferSchema": "true"} if fmt == "csv" else {})).load(path)
    kinds = {"route": "string", "gate_no": "int", "x1": "double", "y1": "double", "x2": "double", "y2": "double"}
    return gates.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()])
