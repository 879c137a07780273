"""Cutting lineage: intermediate tables in the folder that all executors share.

``spark.checkpoint.dir`` names that folder on a cluster. Where it is unset, a temporary folder is made if the master is
local (one process holds driver and tasks); any other master is refused, since its executors could not read it. A lost executor costs nothing that was written here, so no local copies are relied on.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
_LEFT: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="gleanery-")
    return _FALLBACK[app]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession | None = None) -> None:
    """Deletes all tables that results of this process (of ``spark``, if given) were read from. For long sessions: call
    it when a query's result has been written or collected; results not read by then can no longer be."""
    for path, own in list(_LEFT.items()):
        if spark is None or own is spark:
            _delete(own, path)
            _LEFT.pop(path, None)


@atexit.register
def _tidy() -> None:
    for path, spark in list(_LEFT.items()):
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone before Python ends
            pass


class Scratch:
    """Written tables of one operator run. ``keep`` writes and reads back, ``drop`` deletes what is no longer read.

    Tables that a returned (lazy) DataFrame still reads stay until ``release`` is called or Python ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self._paths = spark, {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/gleanery-{uuid.uuid4().hex}"
        df.write.parquet(path)
        _LEFT[path] = self.spark
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for table in tables:
            if table is not None and id(table) in self._paths:
                _, path = self._paths.pop(id(table))
                _delete(self.spark, path)
                _LEFT.pop(path, None)
