"""DataFrames that several queries of a session fan out from: persisted once, released together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_kept: dict[tuple[str, str, str], DataFrame] = {}


def kept(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The DataFrame that ``make`` gave for this session, folder and name; an executor lost with its share is recomputed."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        _kept[key] = make().persist()
    return _kept[key]


def release() -> None:
    """Unpersist everything."""
    while _kept:
        _kept.popitem()[1].unpersist()
