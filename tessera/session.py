"""Session helpers."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once a context, so that Python workers can import it wherever they run."""
    sc = spark.sparkContext
    if not getattr(sc, "_tessera_shipped", False):
        here = os.path.dirname(os.path.abspath(__file__))
        base = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera")
        sc.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(here), os.path.basename(here)))
        sc._tessera_shipped = True
    return spark
