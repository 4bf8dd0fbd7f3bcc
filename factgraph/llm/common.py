"""What the operators of this subpackage share: reading, staged tables, global row numbers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than these.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only in local mode, where it is unset in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts the lineage, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(*tables: DataFrame) -> None:
    """Removes tables that `stage` returned, once nothing reads them any more."""
    for table in tables:
        jvm = table.sparkSession._jvm
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_row_number(df: DataFrame, order: list[Column], name: str, out: str = "row_number") -> tuple[DataFrame, int]:
    """Row numbers from 0 over the whole table in a total order, without one task that sees all rows.

    Rows are range-partitioned and staged with their partition; only the count of each partition
    comes to the driver (as many numbers as there are partitions). Returns the table and its row count.
    """
    parts = width(df.sparkSession)
    ranged = stage(df.repartitionByRange(parts, *order).withColumn("__pid", F.spark_partition_id()), name)
    counts = {r["__pid"]: r["n"] for r in ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], 0
    for pid in range(max(counts, default=-1) + 1):
        offsets.append(total)
        total += counts.get(pid, 0)
    within = F.row_number().over(Window.partitionBy("__pid").orderBy(*order)).cast("long")
    offset = F.element_at(F.lit(offsets or [0]).cast("array<bigint>"), F.col("__pid") + 1)
    return ranged.withColumn(out, offset + within - 1).drop("__pid"), total


def digest_rows(batches, columns: list[str], rows: int = 256):
    """Record batches, cut to at most `rows` rows, as lists of Python values."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield [part.column(part.schema.get_field_index(c)).to_pylist() for c in columns]


def with_unique_id(docs: DataFrame, out: str = "__uid") -> DataFrame:
    """The rows with an id that no other row has, in the order of doc_id: doc_id itself where it is unique, else (null or
    repeated ids) row numbers by doc_id, nulls first, then by text."""
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if odd.isEmpty():
        return docs.withColumn(out, F.col("doc_id").cast("long"))
    return with_row_number(docs, [F.col("doc_id"), F.col("text")], "unique-rows", out)[0]
