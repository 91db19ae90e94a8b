"""Written intermediate tables, and settings of the session the operators rely on."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pagelayout.functions.workers import ship


def prepare(spark: SparkSession) -> None:
    """Make worker functions importable and Arrow batches small.

    Texts can be long, so a batch has at most 500 rows and 16 MB. The settings are the
    session's, as plans read them when they run: they are lowered, never raised.
    """
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 500), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        try:
            now = int(spark.conf.get(key).rstrip("bB"))
            if now <= 0 or now > most:
                spark.conf.set(key, str(most))
        except Exception as e:  # a Spark release without this setting
            if "SQL_CONF_NOT_FOUND" not in str(e) and "NoSuchElement" not in str(e) and not isinstance(e, ValueError):
                raise


def release_memory() -> None:
    """Give a worker's free memory back to the system: workers are kept for later tasks, and so is what they hold."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU library
        pass


def released(run: Callable) -> Callable:
    """`run`, a generator over a task's batches, that gives memory back when it ends."""

    def wrapped(batches):
        yield from run(batches)
        release_memory()

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Where it is unset, a session on this machine alone (master local) gets a
    temporary folder; on a cluster there is none to choose, and that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors share (master is {master})")
        where = "file://" + tempfile.mkdtemp(prefix="pagelayout-")
        spark.conf.set("spark.checkpoint.dir", where)
        atexit.register(shutil.rmtree, where[7:], ignore_errors=True)
    return where.rstrip("/")


class Scratch:
    """Tables written under one folder of the shared directory.

    A written table cuts lineage and survives lost executors. `drop` removes
    tables no later plan reads; what a returned result still reads goes when
    the process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._end)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(f"{self.root}/{name}")

    def _remove(self, where: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _end(self) -> None:
        try:
            self._remove(self.root)
        except Exception:  # the session may have ended before; then the folder stays for the operator of the cluster
            if self.root.startswith("file:///tmp/"):
                shutil.rmtree(self.root[7:], ignore_errors=True)
