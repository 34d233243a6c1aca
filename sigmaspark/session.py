"""Making the package known to a running session's Python workers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the session's executors, once; workers may lack the driver's import path."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="sigmaspark-"), "sigmaspark.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares for checkpoints. A local one stands in only where the master is local: others would not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return f"file://{tempfile.mkdtemp(prefix='sigmaspark-checkpoint-')}"


def shared_path(spark: SparkSession) -> str:
    """A new name in that folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
