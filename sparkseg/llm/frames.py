"""What the operators share: keys of rows, columns apart from the caller's, tables written to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def row_key(*columns: str) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of the columns.  Rows with equal columns share a key, on purpose."""
    return F.xxhash64(*columns).alias("k1"), F.xxhash64(F.lit("key"), *reversed(columns)).alias("k2")


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder: spark.checkpoint.dir.  Only a session within one machine, as in tests, may go without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own.setdefault(context.applicationId, _own.get(context.applicationId) or tempfile.mkdtemp(prefix="shared-"))
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Runs df once and reads it back from the shared folder, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop_cut(*tables: DataFrame) -> None:
    """Deletes tables that cut() wrote, once nothing that is still to run reads them."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.cut_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
