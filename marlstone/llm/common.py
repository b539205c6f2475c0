"""Shared helpers: the working folder, written intermediate tables, their removal, row addresses, expressions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def work_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where it is unset a local master gets a temporary folder; a cluster
    must name one, since each machine would see only its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="marlstone-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: What holds while a table is written: the execution's shuffle files go when it ends, else they stay until the driver happens
#: to collect its garbage; and what Python tasks get at a time is bounded in bytes, not in rows alone.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in WRITING}
    try:
        for k, v in WRITING.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(spark: SparkSession, df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, and a lost executor
    costs a read of the table, not a second run of what made it."""
    path = new_path(spark, name)
    schema = df.schema
    with writing(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path), path


def bucketed(spark: SparkSession, df: DataFrame, name: str, *key: str) -> tuple[DataFrame, str, str]:
    """``df`` written as a table bucketed by ``key`` in the shared folder, so that joins by the key don't move it; with the
    table's name and path, for ``drop_bucketed``."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{name}_{uuid.uuid4().hex[:12]}"
    path = new_path(spark, name)
    with writing(spark):
        df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(parts, *key).saveAsTable(name)
    return spark.table(name), name, path


def drop_bucketed(spark: SparkSession, name: str, path: str) -> None:
    spark.sql(f"DROP TABLE {name}")
    remove(spark, path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that no later step reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def unused(name: str, columns: Iterable[str]) -> str:
    """``name``, with underscores put before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_address(spark: SparkSession, docs: DataFrame, file: str, row: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with two columns that tell its rows apart, the same whenever they are computed: the place in the Parquet
    file a row comes from. What does not come from files is written first; the paths of that are returned."""
    try:
        return docs.select("*", F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row)), []
    except AnalysisException:
        written, path = materialize(spark, docs.withColumn(file, F.lit(0).cast("long")).withColumn(row, F.monotonically_increasing_id()), "rows")
        return written, [path]


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Numbers in a slice of a vector, and tasks whose slices meet at the first level.
SLICE = 4096
FAN = 1024


def _sum(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(v.as_buffer(), np.int64) for v in table.column("v"))
    return pa.table({"g": table.column("g")[:1], "slice": table.column("slice")[:1], "v": pa.array([total.tobytes()], pa.binary())})


def add_up(vectors: DataFrame, size: int) -> np.ndarray:
    """The sum of vectors of ``size`` whole numbers (64-bit, as bytes in the one column), a row for each task. Vectors are cut
    into slices; the same slices of ``FAN`` tasks are added first, then those sums, so a million tasks give no task more than
    ``FAN`` slices of 32 KB. The driver gets one vector."""
    width = SLICE * 8
    pieces = F.expr(f"transform(sequence(0, {size * 8 - 1}, {width}), i -> substring(v, cast(i + 1 as int), {width}))")
    rows = vectors.toDF("v").select(F.floor(F.spark_partition_id() / FAN).cast("int").alias("g"), F.posexplode(pieces).alias("slice", "v"))
    rows = rows.groupBy("g", "slice").applyInArrow(_sum, "g int, slice int, v binary")
    rows = rows.withColumn("g", F.lit(0)).groupBy("g", "slice").applyInArrow(_sum, "g int, slice int, v binary")
    out = np.zeros(size, dtype=np.int64)
    for r in rows.toLocalIterator():
        part = np.frombuffer(r["v"], np.int64)
        out[r["slice"] * SLICE : r["slice"] * SLICE + len(part)] = part
    return out
