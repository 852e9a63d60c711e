"""The package's code on its way to executors, which share no folder with the driver."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package, once for an application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    at = os.path.join(tempfile.mkdtemp(), "crossfile_library.zip")  # read by the driver's own file server only
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, names in os.walk(here):
            for path in (os.path.join(folder, n) for n in names if n.endswith(".py")):
                z.write(path, os.path.join("crossfile", os.path.relpath(path, here)))
    spark.sparkContext.addPyFile(at)
    _SHIPPED.add(app)
