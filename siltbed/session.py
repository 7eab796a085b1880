"""Getting this package to the Python workers of a session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to all executors, once for each application; they fetch it from the driver.

    Rows here hold whole texts, so a session with Arrow's default of 10,000 rows a batch gets 2,000.
    """
    context = spark.sparkContext
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "2000")
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="ship-")) / f"{root.name}.zip"
        with zipfile.ZipFile(target, "w") as out:
            for p in sorted(root.rglob("*.py")):
                out.write(p, p.relative_to(root.parent))
        context.addPyFile(str(target))
        _SHIPPED.add(context.applicationId)
    return spark
