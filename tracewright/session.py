"""Getting this package to the Python workers of a session."""

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_MARK = "_tracewright_shipped"


def ship(spark: SparkSession) -> None:
    """Send this package's source to all executors, once per Spark context.

    Workers that were started elsewhere don't have the driver's import path.
    """
    sc = spark.sparkContext
    if getattr(sc, _MARK, False):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="tracewright-")) / "tracewright.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(path))
    setattr(sc, _MARK, True)
