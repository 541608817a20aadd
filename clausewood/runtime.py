"""What running on a cluster needs: the package reaches every Python worker."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: dict[str, str] = {}


#: Rows and bytes that go to a Python worker at once, where the application sets neither: Spark's own make batches of long texts too large.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "250", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python functions unpickle wherever the driver started."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    for name, value in BATCHES.items():
        if context.getConf().get(name) is None:
            spark.conf.set(name, value)
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="clausewood-")) / "clausewood_package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    context.addPyFile(str(path))
    _shipped[context.applicationId] = str(path)
