"""Tables in the folder that driver and executors share: they cut lineage, and lost executors cost only their tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(path := tempfile.mkdtemp(prefix="spotseam-"))
    return path


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it goes when the session's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(p)
    return path


#: Narrow rows a file of a table whose size is known.
ROWS_A_FILE = 500_000


#: While a table is written: shuffle files go as soon as it is, and Python workers get batches of bounded size.
_WHILE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def cut(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes rows as a table in the shared folder and reads it back: later steps see one and
    the same version of them, whatever executors are lost, and nothing is computed twice.
    ``rows``, a bound of how many there are, keeps a small table from falling into many files."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if rows is not None:
        df = df.coalesce(1 + rows // ROWS_A_FILE)
    before = {k: spark.conf.get(k) for k in _WHILE}
    for k, v in _WHILE.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables of ``cut`` that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_cut_path", None):
            p = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
