"""The whole path from source rows to validated documents."""

from __future__ import annotations

from pyspark.sql import DataFrame

from clausewood.operators.body import with_sections
from clausewood.operators.frontmatter import with_metadata
from clausewood.plans.validate import validate


def parse(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, file, filename, source) with ok, error, metadata and sections."""
    return with_sections(with_metadata(docs)).drop("body")


def check(docs: DataFrame, amended: DataFrame | None = None, attached: DataFrame | None = None) -> DataFrame:
    """Source rows to validated documents."""
    return validate(parse(docs), amended, attached)
