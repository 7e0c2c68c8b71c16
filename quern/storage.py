"""Tables and files in the folder that driver and executors share.

Lineage is cut by writing a table there and reading it again, so a lost executor costs only the
tasks that ran on it. The folder is ``spark.checkpoint.dir``; a session without that setting gets a
temporary folder, and only where it runs on one machine.
"""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder's URI."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and (given := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        found = given.get()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="quern-")
    return f"file://{_LOCAL[app]}"


def new_dir(spark: SparkSession, name: str) -> str:
    """A URI under the shared folder that nothing else uses."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read from there."""
    path = new_dir(df.sparkSession, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame, name: str) -> DataFrame:
    """``df`` evaluated once, so that plans which read it twice get the same rows.

    Types that Parquet can't hold (empty documents, calendar intervals) go to a checkpoint instead.
    """
    try:
        return materialize(df, name)
    except AnalysisException as e:
        if e.getCondition() not in ("EMPTY_SCHEMA_NOT_SUPPORTED_FOR_DATASOURCE", "UNSUPPORTED_DATA_TYPE_FOR_DATASOURCE"):
            raise
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def discard(*tables: DataFrame) -> None:
    """Remove the files of materialized tables that nothing will read again."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        root = f"{shared_root(table.sparkSession)}/"
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            own = jvm.org.apache.hadoop.fs.Path(root)
            if path.toUri().getPath().startswith(own.toUri().getPath()):
                path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, gs, ... as Arrow supports) and the path on it."""
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)
