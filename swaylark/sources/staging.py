"""Tables written in the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Where each staged table lies, and the scope that is open in this thread.
PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
OPEN: ContextVar[Scope | None] = ContextVar("open", default=None)


class Scope:
    """What one call stages, in its own thread: at its end that goes, but for what is kept, which the scope around it has from then on."""

    def __init__(self, spark: SparkSession):
        self.spark, self.made, self.kept = spark, [], []

    def keep(self, *paths: str) -> None:
        self.kept += paths

    def keep_all(self) -> None:
        self.kept = self.made

    def __enter__(self) -> Scope:
        self.around = OPEN.get()
        OPEN.set(self)
        return self

    def __exit__(self, *error) -> None:
        OPEN.set(self.around)
        remove(self.spark, [x for x in self.made if x not in self.kept])
        if self.around:
            self.around.made += self.kept


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, one of our own, in local mode only (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if scope := OPEN.get():
        scope.made.append(path)
    return path


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if scope := OPEN.get():
        scope.made[:] = [x for x in scope.made if x not in paths]


def unstage(*tables: DataFrame) -> None:
    """Delete the files of tables from ``staged`` that nothing reads any more."""
    for df in tables:
        if (path := PATHS.pop(df, None)) is not None:
            remove(df.sparkSession, [path])


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    PATHS[table] = path
    return table
