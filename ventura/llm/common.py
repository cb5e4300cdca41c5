"""Helpers shared by the operators: table reads, lineage cuts, hot keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ventura.session import ship

#: Deleted by the normalisation of exact matching, and the separators of words: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
#: Slices that a key's rows are dealt to in ``lookup``.
SLICES = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder. As every operator begins here, the package is sent to the workers here too."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share; ventura.session.build does for a local session")
    return folder


def cut(df: DataFrame, label: str = "cut", over: DataFrame | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet under the shared folder and read it back.

    The file is compressed and columnar, so it is smaller than an RDD checkpoint, and it survives lost executors. It takes
    the place of the file behind ``over``, an earlier result that nothing reads any more.
    """
    spark = df.sparkSession
    path = over.cut_path if over is not None else f"{shared_dir(spark).rstrip('/')}/ventura-{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path, compression="zstd")
    made = spark.read.schema(df.schema).parquet(path)
    made.cut_path = path
    return made


def free(*spent: DataFrame) -> None:
    """Empty the files behind results of ``cut`` that nothing reads any more."""
    for df in spent:
        df.sparkSession.range(0, 0, 1, 1).write.mode("overwrite").parquet(df.cut_path)


def lookup(rows: DataFrame, key: str, found: DataFrame, by: Column) -> DataFrame:
    """``rows`` left joined with ``found`` (one row per key), however many rows one key has.

    Rows are dealt by the key and one of SLICES slices of the hash ``by``; distinct (key, slice) pairs, at most SLICES a key, meet
    ``found`` and carry its columns to the slices.
    """
    sliced = rows.withColumn("_slice", F.pmod(F.xxhash64(by), F.lit(SLICES)).cast("int"))
    pairs = sliced.select(key, "_slice").distinct().join(found.hint("merge"), key)
    return sliced.join(pairs.hint("merge"), [key, "_slice"], "left").drop("_slice")


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
