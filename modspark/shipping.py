"""Send the package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> None:
    """Add this package, as a zip, to the Python path of the session's workers, once per context.

    The zip is made in the driver's own temporary folder; Spark's file server hands it out.
    """
    sc = spark.sparkContext
    if getattr(sc, "_modspark_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="modspark-"), "modspark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(ROOT):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(ROOT)))
    sc.addPyFile(path)
    sc._modspark_shipped = True
