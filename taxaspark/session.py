"""Session settings the engine relies on, and shipping of its own code to executors."""

from __future__ import annotations

import io
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def configure(spark: SparkSession) -> SparkSession:
    """Settings that results depend on: ANSI errors, and later tags replacing earlier ones of the same name."""
    spark.conf.set("spark.sql.ansi.enabled", "true")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and all runs in one process.

    On a cluster without that setting it raises: each executor would write to a disk of its own, and rows would vanish.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="taxaspark-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application."""
    sc = spark.sparkContext
    root = Path(__file__).resolve().parent
    if sc.applicationId in _shipped or not root.is_dir():
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(f.relative_to(root.parent)))
    path = Path(tempfile.mkdtemp(prefix="taxaspark-")) / "taxaspark_code.zip"
    path.write_bytes(data.getvalue())
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)
