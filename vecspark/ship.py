"""Sends this package to the Python workers of a session that may not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ensure_on_workers(spark: SparkSession) -> None:
    """Adds the package's sources to the session's files, once per application.

    Spark serves them from the driver to every executor, also to those that join later.
    """
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="vecspark-"), "vecspark-sources.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(home):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(home)))
    sc.addPyFile(path)
    _sent.add(sc.applicationId)
