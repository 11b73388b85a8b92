"""The package on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's source to the Python workers, once per application, so that they
    need no installation and no path of their own. The archive is served by the driver."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    place = os.path.join(tempfile.mkdtemp(prefix="siftwarden-"), "siftwarden_src.zip")
    with zipfile.ZipFile(place, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(place)
    _SHIPPED.add(context.applicationId)
