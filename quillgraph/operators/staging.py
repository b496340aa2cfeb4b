"""Results kept in the folder that driver and executors share, so that iterations neither grow their plans nor depend on executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of this machine only for a local session that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def staged(df: DataFrame, label: str) -> DataFrame:
    """Written as Parquet and read again."""
    path = f"{shared_folder(df.sparkSession)}/quillgraph/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
