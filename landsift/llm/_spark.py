"""What the operators share: cutting lineage, shipping code to workers, summing arrays over partitions."""

from __future__ import annotations

import math
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]
SMALL = 2 << 20  # bytes of a table's files up to which each executor may hold it whole
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session in one process
    (master local) gets a temporary one; a cluster gets an error, as its executors couldn't read such a folder."""
    held = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        held = f"file://{tempfile.mkdtemp(prefix='landsift-')}"
        spark.sparkContext.setCheckpointDir(held)
        held = spark.sparkContext.getCheckpointDir() or held
    return held


def cut(df: DataFrame, few: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: the lineage ends there, a lost executor costs no
    recomputation, and unlike checkpoint() the plan runs once and the files are compressed and columnar. few: of what is
    small, `gathered` first, so that there is a file a core and not one a partition."""
    spark = df.sparkSession
    df = gathered(df, 1) if few else df
    path = f"{shared_dir(spark)}/landsift-{uuid.uuid4().hex}"
    df.write.parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    held._landsift_path = path
    return held


def remove(df: DataFrame) -> None:
    """Delete a table that `cut` wrote and that nothing reads any more."""
    discard(df.sparkSession, df._landsift_path)


def fits(df: DataFrame, share: int = 1) -> bool:
    """Whether df is a table of `cut` of which one row in `share` may be broadcast: its files have up to SMALL bytes times
    that."""
    if not (path := getattr(df, "_landsift_path", None)):
        return False
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getContentSummary(where).getLength() <= SMALL * share


def gathered(df: DataFrame, each: int) -> DataFrame:
    """df in at most `each` partitions a core, without an exchange."""
    return df.coalesce(each * max(1, df.sparkSession.sparkContext.defaultParallelism))


def sent(df: DataFrame, small: bool) -> DataFrame:
    """df, to be broadcast to a join if it is small: then the other side needs no exchange."""
    return F.broadcast(df) if small else df


def discard(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def by_size(batches: Iterator[pa.RecordBatch], column: int | str, rows: int = 128, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of up to `rows` rows whose strings (or binaries) in `column` have up to `size` bytes together; a longer
    one is a slice of its own. So what a worker holds at once follows the longest text, not the number of long ones."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
            yield b.slice(at, to - at)
            at = to


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver found it by sys.path alone, and hand them batches of
    BATCH_BYTES at most (a batch ends with the row that exceeds them): what JVM and worker hold of a batch of long texts
    is so bounded. A lesser setting stays."""
    sc = spark.sparkContext
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH)) > BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))
    seen = {os.path.abspath(p) for p in [*os.environ.get("PYTHONPATH", "").split(":"), os.getcwd()] if p}
    if str(ROOT) in seen or getattr(sc, "_landsift_shipped", False):
        return
    base = Path(tempfile.mkdtemp()) / "landsift_code"
    sc.addPyFile(shutil.make_archive(str(base), "zip", ROOT, "landsift"))
    sc._landsift_shipped = True


def partition_sum(df: DataFrame, width: int) -> np.ndarray:
    """Sum of the float64 arrays in df's single binary column (one row a partition, `width` numbers each), added up in
    a tree of fan-in 32, so that neither a task nor the driver holds more than a few dozen of them."""
    parts = df.rdd.map(lambda r: np.frombuffer(r[0], dtype=np.float64))
    n = max(2, parts.getNumPartitions())
    return np.array(parts.treeAggregate(np.zeros(width), np.add, np.add, depth=max(2, math.ceil(math.log(n, 32)))))
