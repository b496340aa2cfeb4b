"""Tables that change a folder at a time, and switch to their next version as a whole.

A table's rows lie in folders by bucket. A version is a short list of (bucket, folder), written last and in one commit, so
readers see a change whole or not at all; what a failed run has left is never listed. Old versions stay readable, as folders
are never written twice. A change carries the number of its batch: a batch that was already taken changes nothing.
One writer at a time: a second one that makes the same version fails, as its folder is there.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ENTRY = "bucket string, folder string, batch long"


@dataclass(frozen=True)
class Version:
    number: int
    batch: int  #: of the last change (-1: none yet)
    folders: dict[str, str]  #: by bucket


def versions(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema(f"{_ENTRY}, version int").option("basePath", f"{root}/versions").parquet(f"{root}/versions")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def version(spark: SparkSession, root: str, number: int | None = None) -> Version:
    """The newest version, or the one of that number."""
    rows = versions(spark, root)
    if rows is not None:
        rows = rows.where(F.col("version") == number) if number is not None else rows.where(F.col("version") == F.lit(rows.agg(F.max("version")).first()[0]))
        if found := rows.collect():  # a row a bucket
            return Version(found[0]["version"], max(r["batch"] for r in found), {r["bucket"]: r["folder"] for r in found if r["bucket"] is not None})
    if number:
        raise ValueError(f"no version {number} in {root}")
    return Version(0, -1, {})


def read(spark: SparkSession, root: str, schema: str, number: int | None = None, buckets: list[str] | None = None) -> DataFrame:
    """The rows of a version, or those in some of its buckets."""
    now = version(spark, root, number)
    paths = [f for b, f in now.folders.items() if buckets is None or b in set(buckets)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def replace(rows: DataFrame, bucket: Column, touched: list[str], root: str, batch: int) -> Version:
    """The next version: in the ``touched`` buckets ``rows`` stand in place of what was there, all others stay."""
    spark = rows.sparkSession
    now = version(spark, root)
    if batch <= now.batch:
        return now
    data = f"{root}/data/{uuid.uuid4().hex}"
    # by bucket first: a bucket is a file or a few, not one for every task
    rows.withColumn("_bucket", bucket.cast("string")).repartition("_bucket").write.partitionBy("_bucket").parquet(data)
    made = {r[0] for r in spark.read.schema("_bucket string").parquet(data).select("_bucket").distinct().collect()} if touched else set()
    folders = {b: f for b, f in now.folders.items() if b not in touched} | {b: f"{data}/_bucket={b}" for b in touched if b in made}
    entries = [(b, f, batch) for b, f in sorted(folders.items())] or [(None, None, batch)]
    spark.createDataFrame(entries, _ENTRY).coalesce(1).write.parquet(f"{root}/versions/version={now.number + 1}")
    return Version(now.number + 1, batch, folders)


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("string")


def upsert(fresh: DataFrame, key: str, root: str, batch: int, newest: str | None = None, buckets: int = 64) -> Version:
    """Rows of ``fresh`` in place of those of the same key; of several in ``fresh`` the one with the largest ``newest``.

    Only folders that hold a touched key are read and written again. Rows with a null key are left out.
    """
    spark = fresh.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fresh.schema)
    now = version(spark, root)
    if batch <= now.batch:
        return now
    rows = fresh.where(F.col(key).isNotNull())
    others = [c for c in fresh.columns if c != key]
    order = F.struct(newest, *others) if newest else F.struct(*others)
    rows = rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_row")).select(key, "_row.*").select(fresh.columns)
    touched = [r[0] for r in rows.select(bucket_of(key, buckets)).distinct().collect()]  # at most ``buckets``
    kept = read(spark, root, schema, buckets=touched).join(rows.select(key), key, "left_anti").select(fresh.columns)
    return replace(kept.unionByName(rows), bucket_of(key, buckets), touched, root, batch)
