"""Cutting lineage, and tables that are rewritten as a whole."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[2]


def scratch(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where it is unset, a session in one process (master local) gets a
    temporary one; a cluster gets an error, as its executors couldn't read such a folder."""
    held = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='landsift-')}")
        held = spark.sparkContext.getCheckpointDir()
    return held


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back."""
    path = f"{scratch(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver found it by sys.path alone."""
    sc = spark.sparkContext
    seen = {os.path.abspath(p) for p in [*os.environ.get("PYTHONPATH", "").split(":"), os.getcwd()] if p}
    if str(ROOT) in seen or getattr(sc, "_landsift_shipped", False):
        return
    base = Path(tempfile.mkdtemp()) / "landsift_code"
    sc.addPyFile(shutil.make_archive(str(base), "zip", ROOT, "landsift"))
    sc._landsift_shipped = True
