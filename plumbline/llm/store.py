"""Intermediate tables in the folder that driver and executors share.

The folder is the cluster's ``spark.checkpoint.dir``. Where none is set, a local master (tests, one machine)
gets a temporary folder; any other master raises an error, since its machines would not see one another's
files. A written table cuts lineage and survives the loss of any executor.

Tables written inside a ``scope`` are dropped, files and catalog entry, when it ends; those that are kept
pass to the scope around it. What no scope drops goes when the application ends.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_scopes: list[list[Table]] = []
_named: dict[str, Table] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder of this application inside ``spark.checkpoint.dir``."""
    app = spark.sparkContext.applicationId
    if app not in _own:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        _own[app] = f"{base.rstrip('/')}/plumbline-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_end, spark, _own[app])
    return _own[app]


def _alive(spark: SparkSession) -> bool:
    return spark.sparkContext._jvm is not None and spark.sparkContext._jsc is not None


def _remove(spark: SparkSession, path: str) -> None:
    if _alive(spark):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _end(spark: SparkSession, path: str) -> None:
    if _alive(spark):
        for table in list(_named.values()):
            table.drop()
        _remove(spark, path)


class Table:
    """A written table: ``df`` reads it, ``drop()`` removes it once nothing reads it, ``keep()`` hands it on."""

    def __init__(self, spark: SparkSession, path: str, schema=None, name: str | None = None):
        self.spark, self.path, self.name, self.kept = spark, path, name, False
        self.df = spark.table(name) if name else spark.read.schema(schema).parquet(path)
        if name:
            _named[name] = self
        if _scopes:
            _scopes[-1].append(self)

    def keep(self) -> Table:
        self.kept = True
        return self

    def drop(self) -> None:
        if self.name and _named.pop(self.name, None) and _alive(self.spark):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        _remove(self.spark, self.path)


@contextlib.contextmanager
def scope() -> Iterator[list[Table]]:
    """Tables written inside are dropped at the end, but for those that are kept."""
    own: list[Table] = []
    _scopes.append(own)
    try:
        yield own
    finally:
        _scopes.remove(own)
        for table in own:
            if table.kept:
                table.kept = False
                if _scopes:
                    _scopes[-1].append(table)
            else:
                table.drop()


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more; it waits for the JVM's collector."""
    gc.collect()
    if _alive(spark):
        spark.sparkContext._jvm.System.gc()


def write_table(df: DataFrame, name: str, codec: str = "zstd", rows_per_file: int = 0) -> Table:
    """Write ``df`` to the shared folder; read it back through ``.df``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:10]}"
    w = df.write.option("compression", codec).option("parquet.enable.dictionary", "false")
    if rows_per_file:
        w = w.option("maxRecordsPerFile", rows_per_file)
    w.parquet(path)
    return Table(spark, path, df.schema)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int, codec: str = "none") -> Table:
    """Write ``df`` as a table bucketed by ``key``: later joins on ``key`` read it without a shuffle."""
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex[:10]}"
    path = f"{shared_dir(spark)}/{name}"
    (df.write.format("parquet").option("path", path).option("compression", codec).option("parquet.enable.dictionary", "false").option("parquet.block.size", 32 << 20)
     .bucketBy(buckets, key).saveAsTable(name))
    return Table(spark, path, name=name)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts."""
    from pyspark.sql import functions as F

    return docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0


def chunk_counter():
    """Ids for the chunks of one task: the partition in the high bits. A task that runs again gives the same ids."""
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << 32
    while True:
        yield at
        at += 1
