"""Gives Python workers the library where they can't import it from their own path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession, *modules: str) -> None:
    """Send this package, and top-level modules beside it, to the executors: once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(package)
    path = os.path.join(tempfile.mkdtemp(), f"{os.path.basename(package)}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                whole = os.path.join(folder, name)
                out.write(whole, os.path.relpath(whole, root))
        for name in modules:
            if os.path.exists(os.path.join(root, name)):
                out.write(os.path.join(root, name), name)
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)
