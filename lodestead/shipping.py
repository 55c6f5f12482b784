"""Sends this package to the executors of a session that can't import it by themselves."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once an application."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    work = tempfile.mkdtemp(prefix="lodestead-")
    shutil.copytree(here, os.path.join(work, "code", "lodestead"), ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(work, "lodestead"), "zip", os.path.join(work, "code")))
    _sent.add(sc.applicationId)
