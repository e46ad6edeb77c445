"""Shared pieces of the operators: byte access to Arrow batches, the shared folder, reading tables."""

from __future__ import annotations

import gc
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: XXH64 and friends take the bytes of a text; six ASCII characters separate words everywhere here.
SPACES = b"\t\n\x0b\x0c\r "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes, nulls as empty, without decoding."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values. For integers sorting is many times faster than np.unique, which hashes."""
    a = np.sort(a)
    return a if len(a) < 2 else a[np.concatenate(([True], a[1:] != a[:-1]))]


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches cut into pieces of at most so many rows: what is made from a piece is what a worker holds."""
    for whole in batches:
        for lo in range(0, whole.num_rows, rows):
            yield whole.slice(lo, rows)


def by_batch(df: DataFrame, rows: Callable[[pa.RecordBatch], dict], schema: str, arrow_schema: pa.Schema) -> DataFrame:
    """Map each Arrow batch to one batch of new columns; nothing is kept between batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(rows(batch), schema=arrow_schema)

    return df.mapInArrow(run, schema)


def remainder(id_col: Column, mod: int) -> Column:
    """crc32(id as text) mod ``mod``; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(mod)


def _target(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def shared_folder(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder of the session. Where none is set, a session within one machine (tests) gets a
    temporary one; any other raises, since executors could not read each other's files."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="marginalia-")
        spark.sparkContext.setCheckpointDir(root)
        drop_at_exit(spark, root)
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, release: bool = False) -> DataFrame:
    """Cut the lineage: write to the shared folder, read back. Survives lost executors. The files go when the driver ends,
    or before that by ``dropped``. ``release``: after a large shuffle, drop its plan and collect garbage, so that Spark's
    cleaner deletes the shuffle files now."""
    spark, schema = df.sparkSession, df.schema
    path = shared_folder(spark, what)
    df.write.parquet(path)
    drop_at_exit(spark, path)
    del df
    if release:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete what ``stored`` wrote. Nothing that is still to run may read it."""
    for df in tables:
        drop_folder(df.sparkSession, df.stored_at)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    system, target = _target(spark, path)
    system.delete(target, True)


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Delete an existing folder when the driver ends."""
    system, target = _target(spark, path)
    system.deleteOnExit(target)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
