"""Readies a session for functions that run in Python on the executors: this package's modules, and batches of bounded size."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows go to Python in batches of about so many bytes, whatever their length; held on both sides, by every task.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def ship(spark: SparkSession) -> None:
    """Add the package to the executors' path, once a context, and bound batches, once a session that sets no bound."""
    sc = spark.sparkContext
    if not getattr(spark, "_cloneloom_bounded", False):
        if not sc.getConf().contains(BATCH_SETTING):
            spark.conf.set(BATCH_SETTING, BATCH_BYTES)
        spark._cloneloom_bounded = True
    if getattr(sc, "_cloneloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="cloneloom-code-")) / "cloneloom_code.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._cloneloom_shipped = True
