"""Session helpers."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
_LOCAL: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a purely local session, where one machine runs everything, may go
    without that setting; it then gets one temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="eventloom-")
    return _LOCAL[app]


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/eventloom/{name}-{uuid.uuid4().hex[:12]}"


def stored(df, name: str):
    """``df`` written to the shared folder and read back: what several branches of a plan read is then computed once, and
    a lost executor costs nothing of what lies before."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once per application. The
    workers may have neither the driver's folder nor its ``sys.path``."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp()  # of code, for the driver alone
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "eventloom_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(top, n)
                    z.write(full, os.path.join("eventloom", os.path.relpath(full, here)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
