"""Makes the package importable for Python workers that do not see this folder."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package along as a Python file, unless workers find it by PYTHONPATH or the working folder."""
    sc = spark.sparkContext
    paths = [Path(p).resolve() for p in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)) if p]
    if ROOT in paths or any((p / "hexsupport").exists() for p in paths) or sc.applicationId in _DONE:
        return
    target = f"{tempfile.mkdtemp(prefix='hexsupport-')}/hexsupport.zip"  # served to executors as long as the session lives
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted((ROOT / "hexsupport").rglob("*.py")):
            out.write(source, source.relative_to(ROOT))
    sc.addPyFile(target)
    _DONE.add(sc.applicationId)
