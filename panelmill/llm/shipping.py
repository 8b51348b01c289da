"""The package's code on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

import panelmill
from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that they need no installation of it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(panelmill.__file__)
    archive = os.path.join(tempfile.mkdtemp(prefix="panelmill-code-"), "panelmill-code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("panelmill", os.path.relpath(path, top)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
