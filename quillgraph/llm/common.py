"""Helpers shared by the training-data operators: tables, shared folders, staged results."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import shared_folder, staged  # noqa: F401  (the operators take them from here)

#: Id that stands for a null document id inside the operators: it sorts after every real one.
NULL_ID = np.iinfo(np.int64).max
#: ASCII white space of the word rule ``[^\x20\x09-\x0D]+``.
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucketed(df: DataFrame, key: str, buckets: int, label: str) -> DataFrame:
    """The same in files of the shared folder in buckets by ``key``: what is grouped by it later isn't shuffled again.

    The catalogue knows the files only while they are being written and looked up; no table is left in it.
    """
    spark = df.sparkSession
    name = f"quillgraph_{label}_{uuid.uuid4().hex}"
    buckets = min(max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    df.write.bucketBy(buckets, key).option("path", f"{shared_folder(spark)}/quillgraph/{name}").saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # of an external table this leaves the files, and ``found`` has been resolved to them
    return found


def documents_of(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra columns of any name can't clash with those an operator adds."""
    small_batches(df.sparkSession)
    return df.select(*[F.col(c) for c in columns])


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Long texts go to Python in batches of at most ``rows``, which bounds the memory of its workers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows or int(spark.conf.get(name)) <= 0:
        spark.conf.set(name, str(rows))


KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}


def arrow_schema(schema: str) -> pa.Schema:
    """Of a plain list of ``name kind``."""
    return pa.schema([(f.split()[0], KINDS[f.split()[1]]) for f in schema.split(", ")])


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def by_text(docs: DataFrame, judge: Callable[[list[str | None]], list[tuple]], schema: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``judge`` gives a tuple for each text; the columns ``keep`` come first in ``schema`` and pass by it untouched, so that
    ids of any size stay exact beside nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = arrow_schema(schema)
        made = pa.schema(list(kinds)[len(keep) :])
        for part in slices(batches):
            out = batch_of(judge(part.column("text").to_pylist()), made)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *out.columns], schema=kinds)

    return documents_of(docs, *keep, "text").mapInArrow(run, schema)


def with_text(docs: DataFrame, change: Callable[[list[str | None]], list[str | None]]) -> DataFrame:
    """The same rows and columns with other texts; nothing else is touched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            i = part.schema.get_field_index("text")
            yield part.set_column(i, part.schema.field(i), pa.array(change(part.column(i).to_pylist()), part.schema.field(i).type))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8 (``bytes.split`` splits at exactly these characters)."""
    return utf8(text).split()


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (well-known multiply and xor-shift steps)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
