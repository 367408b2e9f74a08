"""Tables in the folder that the cluster shares: they cut the lineage of iterative plans and outlive lost executors.

`Scratch` is a folder of named tables, `cut` a table without a name. What was written goes when its owner says so
(`drop`, `dropped`), when a `scope` ends, and at the latest when the program does."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: While tables are written: shuffle files go afterwards, and batches to Python are small.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. A folder of our own only where it is unset and all tasks run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="loomgraph-"))
    return context.getCheckpointDir().rstrip("/")


def _write(df: DataFrame, path: str, together: int | None = None) -> DataFrame:
    conf = df.sparkSession.conf
    wanted = _WRITING if together is None else _WRITING | {"spark.sql.execution.arrow.maxRecordsPerBatch": str(together)}
    before = {k: conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            conf.set(k, v)
        df.write.mode("overwrite").parquet(path)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _sweep(kept: int = 0) -> None:
    while len(_written) > kept:
        spark, path = _written.pop()
        if spark.sparkContext._jsc is not None:
            try:
                _delete(spark, path)
            except Exception:  # the session is ending; what it can't reach any more it can't delete
                return


atexit.register(_sweep)


@contextmanager
def scope() -> Iterator[None]:
    """Tables written inside go at the end: results have to be written or collected by then."""
    kept = len(_written)
    try:
        yield
    finally:
        _sweep(kept)


class Scratch:
    """Named tables under a folder of their own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _written.append((spark, self.root))

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """The rows from the written table. Shuffle files that the write needed go with it."""
        return _write(df, f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        _delete(self.spark, f"{self.root}/{name}")


def cut(df: DataFrame, together: int | None = None) -> DataFrame:
    """The same rows from a written table: a lost executor costs a read, not the loop so far. together: rows that go to
    Python in a batch, where they are large."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    _written.append((df.sparkSession, path))
    out = _write(df, path, together)
    out._cut_path = path
    return out


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The rows over as many tasks as run side by side, by a key that has many values: a small file is one task's scan, and
    a table that is written from it would go on as one task's."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables that `cut` gave and nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_cut_path", None):
            _delete(df.sparkSession, path)
            _written[:] = [w for w in _written if w[1] != path]
