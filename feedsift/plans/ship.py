"""Gives the executors' Python workers this package, wherever the driver has it from."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the application's Python files, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="feedsift-")) / f"{top.name}.zip"  # served as long as the application runs
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(archive))
    # the worker that starts a stream's stateful operator on the driver is given no Python files, but this
    path = spark.sparkContext.environment
    path["PYTHONPATH"] = os.pathsep.join(filter(None, [str(archive), path.get("PYTHONPATH")]))
    _shipped.add(app)
