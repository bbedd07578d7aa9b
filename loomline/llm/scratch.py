"""Written tables that cut lineage and survive lost executors.

Tables go to a fresh folder under ``spark.checkpoint.dir``, which all executors and the driver share. Where the
setting is absent (a local session, as in tests) a temporary folder is made and the session is told of it; a
session on a cluster without the setting is refused, as a machine-local folder would not be seen elsewhere.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        got = tempfile.mkdtemp(prefix="loomline-")
        spark.conf.set("spark.checkpoint.dir", got)
        atexit.register(shutil.rmtree, got, ignore_errors=True)
    return got.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and return a reader of what was written."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """As materialize(), stored in as many Spark buckets by ``key`` as there are shuffle partitions: joins and groups of
    such tables by the key need no exchange. The name in the catalogue is unique; the files are in the shared folder.
    """
    spark = df.sparkSession
    table = f"loomline_{name}_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(parts, key).sortBy(key).option("path", f"{folder(spark)}/{table}").saveAsTable(table)
    return spark.table(table)


def release(spark: SparkSession) -> None:
    """Let executors drop the shuffle files of tables that are written: they do so once the driver's JVM collects its
    references to them, which else happens only when its heap fills."""
    spark.sparkContext._jvm.System.gc()
