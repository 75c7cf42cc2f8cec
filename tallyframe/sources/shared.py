"""The folder that all machines see, and the package for Python workers."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, on one machine, an own folder (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    made = "file://" + tempfile.mkdtemp(prefix="shared-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def fresh(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def mounted(uri: str) -> str:
    """The local path of a ``file:`` folder, a mount that every machine sees."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"a mounted folder is needed, not {uri}")
    return unquote(parts.path)


def send_package(spark: SparkSession) -> None:
    """Python workers get this package unless they find it where the driver did (PYTHONPATH or working folder)."""
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    seen = [os.path.abspath(p or ".") for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), ""]]
    context = spark.sparkContext
    if home not in seen and not getattr(context, "_tallyframe_shipped", False):
        context.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "tallyframe"), "zip", home, "tallyframe"))
        context._tallyframe_shipped = True
