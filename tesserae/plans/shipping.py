"""Lets Python workers find this package where the driver found it by its own search path.

On a cluster the package reaches executors by --py-files or their image; the path set here then does no harm.
"""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def ship(spark: SparkSession) -> None:
    seen = spark.sparkContext.environment
    paths = [p for p in seen.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        seen["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
