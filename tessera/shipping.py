"""Sends this package to the executors, so that Python functions find it wherever the driver found it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package as a Python file, once for each application."""
    context = spark.sparkContext
    root = Path(__file__).resolve().parent
    if getattr(context, "_tessera_shipped", False) or not root.is_dir():
        return
    path = Path(tempfile.mkdtemp(prefix="tessera-")) / "tessera.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, Path("tessera") / p.relative_to(root))
    context.addPyFile(str(path))
    context._tessera_shipped = True
