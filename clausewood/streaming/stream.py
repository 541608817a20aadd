"""Validation of a stream of files: the same map over rows, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausewood import engine
from clausewood.plans.report import diagnostics
from clausewood.sources.readers import EXTENSIONS_GLOB, files_to_rows

FILES = "path string, modificationTime timestamp, length long, content binary"


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Markup files as they arrive below a directory."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", EXTENSIONS_GLOB).load(path)
    return files_to_rows(files)


def diagnostics_stream(rows: DataFrame) -> DataFrame:
    """Diagnostics of each arriving document."""
    return diagnostics(engine.check(rows.where("readable")))
