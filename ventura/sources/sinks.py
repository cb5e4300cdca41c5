"""Sinks that survive a failure: a part per shard with a manifest, and tables replaced as a whole.

Both write rows to a folder of the attempt's own first and tell of them last, in a small JSON file that Spark's committer
renames into place. Readers go by these files alone, so what a killed writer left is never seen, and a repeated attempt neither
adds a copy nor leaves a gap. All goes through Spark's readers and writers, so any file system of Spark's will do.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

_ENTRY = "name string, path string, rows long"


def _entries(spark: SparkSession, folder: str, kind: str) -> DataFrame | None:
    """Entries told of so far; None before the first."""
    try:
        return spark.read.schema(_ENTRY).json(f"{folder}/{kind}/*")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _tell(spark: SparkSession, folder: str, kind: str, name: str, path: str, rows: int) -> None:
    """The last act of a write. Fails if there is an entry of this name already."""
    spark.createDataFrame([(name, path, rows)], _ENTRY).coalesce(1).write.mode("errorifexists").json(f"{folder}/{kind}/{name}")


def _write(df: DataFrame, folder: str, name: str) -> tuple[str, int]:
    path = f"{folder}/rows/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path).count()


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """name, path, rows of every committed part."""
    there = _entries(spark, folder, "manifest")
    return spark.createDataFrame([], _ENTRY) if there is None else there


def commit_part(df: DataFrame, folder: str, shard: str) -> bool:
    """Write the rows of one shard as one immutable part; False, with nothing written, if the shard is committed already.

    ``shard`` names the input, such as a batch id or a file, and is the unit that is done or not done. Shards are of letters,
    digits, ``.``, ``_`` and ``-``, and don't begin with ``.`` or ``_``.
    """
    spark = df.sparkSession
    if not shard or shard[0] in "._" or not all(c.isalnum() or c in "._-" for c in shard):
        raise ValueError(f"no name of a shard: {shard!r}")
    if not manifest(spark, folder).filter(F.col("name") == shard).isEmpty():
        return False
    path, rows = _write(df, folder, shard)
    _tell(spark, folder, "manifest", shard, path, rows)
    return True


def read_parts(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All rows of committed parts, with their shard's name. The list of parts, not their rows, passes through the driver."""
    parts = manifest(spark, folder).select("name", "path").collect()
    if not parts:
        return spark.createDataFrame([], schema).withColumn("shard", F.lit(None).cast("string"))
    rows = spark.read.schema(schema).parquet(*(p["path"] for p in parts))
    return rows.withColumn("shard", F.regexp_extract(F.col("_metadata.file_path"), r"/rows/([^/]+)-[0-9a-f]{32}/[^/]*$", 1))


def pending_shards(shards: DataFrame, folder: str, name: str = "shard") -> DataFrame:
    """Rows of ``shards`` whose shard isn't committed: where a run takes up its work again."""
    done = manifest(shards.sparkSession, folder).select(F.col("name").alias("_done"))
    return shards.join(done, F.col(name) == F.col("_done"), "left_anti")


def stream_parts(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write a stream's micro-batches as parts, exactly once: a batch that Spark repeats after a failure is known by its id.

    One stream per folder, and its checkpoint goes with the folder. Takes the input there is, then ends.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        commit_part(batch, folder, f"batch-{batch_id:012d}")

    return stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def version(spark: SparkSession, folder: str) -> tuple[int, str] | None:
    """Number and path of the version that readers see."""
    there = _entries(spark, folder, "version")
    last = there.agg(F.max(F.struct(F.col("name").cast("long").alias("n"), "path")).alias("v")).first()["v"] if there is not None else None
    return (last["n"], last["path"]) if last else None


def publish(df: DataFrame, folder: str, over: int | None = None) -> int:
    """Replace the table in ``folder`` as a whole; readers see the old rows until the new version is told of. Returns its number.

    ``over`` is the version the rows were made from, the present one if not given: if another writer was faster, the write
    fails and nothing changes. Old versions stay for readers that have begun.
    """
    spark = df.sparkSession
    now = version(spark, folder)
    number = (over if over is not None else now[0] if now else 0) + 1
    path, rows = _write(df, folder, f"v{number}")
    _tell(spark, folder, "version", str(number), path, rows)
    return number


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the present version."""
    now = version(spark, folder)
    if now is None:
        raise FileNotFoundError(f"no version was ever published in {folder}")
    return spark.read.parquet(now[1])


def replace_by_name(folder: str, new: DataFrame) -> int:
    """Publish the present rows and new ones together, by column name; columns that either lacks are null."""
    now = version(new.sparkSession, folder)
    return publish(current(new.sparkSession, folder).unionByName(new, allowMissingColumns=True), folder, now[0])
