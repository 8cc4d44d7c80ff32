"""Where iterative plans keep their rounds: written tables in the cluster's shared folder, so that a lost executor costs no earlier round."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_scratch: list[list[str]] = []
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and all of Spark runs on this machine, as in tests."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own[app] = "file://" + tempfile.mkdtemp(prefix="factweave-")
    return _own[app]


def shared_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/factweave/{name}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside are removed at the end: for steps whose result has itself been written by then."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            remove(spark, path)


def settle(df: DataFrame, name: str = "round") -> DataFrame:
    """Writes df into the shared folder and reads it back."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that df reads, as Spark's planner knows them without reading them; 0 where it doesn't."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 50)


#: Bytes of stored input that one task of a spread shuffle stands for.
TASK_BYTES = 4 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by these columns over as many tasks as its input asks for, and never fewer than the session's, so that what a task holds does not grow with the tables."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(20_000, -(-input_bytes(df) // TASK_BYTES))), *keys)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    out = os.path.join(tempfile.mkdtemp(prefix="factweave-ship-"), f"{top.name}.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(out)
    _shipped.add(app)


def numbered(df: DataFrame, order: list[str], first: int = 0) -> DataFrame:
    """Adds seq: first, first + 1, ... in this order. The driver adds up one count for each task, no task gets all rows."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    placed = settle(sorted_.withColumn("_id", F.monotonically_increasing_id()).withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id"), "numbered")
    base, starts = first, []
    for part, n in sorted(tuple(r) for r in placed.groupBy("_part").count().collect()):
        starts.append((part, base))
        base += n
    by_part = df.sparkSession.createDataFrame(starts, "_part long, _base long")
    return placed.join(F.broadcast(by_part), "_part").withColumn("seq", F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")
