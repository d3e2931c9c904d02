"""Session defaults and the shared working folder."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "vecloom") -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did, if they see that path.

    Clusters whose workers do not share it add the package by ``--py-files`` or in their image.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach: ``spark.checkpoint.dir``.

    Only where the setting is absent (tests, one machine) a temporary folder is made
    and remembered in the session.
    """
    ship(spark)
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='vecloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path of this name in the shared folder."""
    return f"{shared_dir(spark)}/vecloom/{name}-{uuid.uuid4().hex}"


_scopes: list[Scratch] = []


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if _scopes:
        _scopes[-1].paths.append(path)
    return out


_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}


def local_table(spark: SparkSession, schema: str, columns: Sequence = ()) -> DataFrame:
    """A table of the driver's columns, none for an empty one, as Arrow: lists of rows and pandas frames would
    pass Python workers of their own on the executors, next to those of searches."""
    fields = [f.split() for f in schema.split(", ")]
    arrays = [pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns or [[]] * len(fields), fields, strict=True)]
    return spark.createDataFrame(pa.table(arrays, [name for name, _ in fields]), schema)


def read_once(held: Broadcast):
    """A broadcast's value, which the worker does not keep: it is read from the executor's file each time.

    Encrypted ones come with the task and are kept by Spark.
    """
    path = getattr(held, "_path", None)
    return held.value if path is None or hasattr(held, "_value") else held.load_from_path(path)


class Scratch:
    """Deletes the tables that were materialized inside it, but those it was told to ``keep``.

    Results that still read a table lazily need it kept. On leaving, the driver is asked to collect its
    garbage, because Spark holds the shuffle files of finished work until then.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        _scopes.append(self)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, a materialized table, outlives this scope and belongs to the one around it."""
        if df._stored_at in self.paths:
            self.paths.remove(df._stored_at)
            if len(_scopes) > 1:
                _scopes[-2].paths.append(df._stored_at)
        return df

    def drop(self, df: DataFrame) -> None:
        """Delete this table now."""
        if df._stored_at in self.paths:
            self.paths.remove(df._stored_at)
            self._delete(df._stored_at)

    def _delete(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def __exit__(self, *failed) -> None:
        _scopes.remove(self)
        for path in self.paths:
            self._delete(path)
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
