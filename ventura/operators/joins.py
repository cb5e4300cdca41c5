"""Join operators that compose DataFrame joins and windows."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows of each key; Spark turns the filter into a group limit before the shuffle."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_k") <= k).drop("_k")


def as_of_backward(df: DataFrame, key: str, ts: str, value: str, lag: timedelta, tolerance: timedelta | None = None) -> DataFrame:
    """For each row the key's last ``value`` at or before ``ts - lag``, by one range window and no self-join.

    With ``tolerance`` a value older than ``ts - lag - tolerance`` doesn't count; ``prior`` is null where none does.
    """
    micros = lambda d: d // timedelta(microseconds=1)
    oldest = Window.unboundedPreceding if tolerance is None else -micros(lag + tolerance)
    w = Window.partitionBy(key).orderBy("_at").rangeBetween(oldest, -micros(lag))
    # of rows with equal times the largest value counts, so that ties have one answer
    last = F.max(F.struct("_at", value)).over(w)
    return df.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("prior", last[value]).drop("_at")


def match_entities(records: DataFrame, firms: DataFrame) -> DataFrame:
    """Adds ``match_id``: the firm of the record's domain, else of its normalised name; the smallest id wins.

    Both lookup sides hold one row per key, so records are never multiplied.
    """
    by_domain = firms.filter("domain IS NOT NULL").groupBy(F.lower("domain").alias("_d")).agg(F.min("id").alias("_by_domain"))
    by_name = firms.filter("normalized_name IS NOT NULL").groupBy(F.col("normalized_name").alias("_n")).agg(F.min("id").alias("_by_name"))
    out = records.join(by_domain, F.lower("domain") == F.col("_d"), "left").join(by_name, F.col("normalized_name") == F.col("_n"), "left")
    return out.withColumn("match_id", F.coalesce("_by_domain", "_by_name")).drop("_d", "_n", "_by_domain", "_by_name")


def identity_key(domain: Column, name: Column) -> Column:
    return F.coalesce(F.lower(domain), F.concat(F.lit("n:"), F.lower(name)))


def missing_rows(source: DataFrame, target: DataFrame) -> DataFrame:
    """Rows of ``source`` whose domain, else name, isn't in ``target``; one row per key, that of the smallest id."""
    keyed = source.withColumn("_key", identity_key(F.col("domain"), F.col("name")))
    there = target.select(identity_key(F.col("domain"), F.col("name")).alias("_key")).distinct()
    return top_per_key(keyed.join(there, "_key", "left_anti"), ["_key"], [F.col("id")]).drop("_key")


def cosine_to(vector: Column, other: Column) -> Column:
    """Cosine of two arrays of numbers."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(vector, other) / F.sqrt(dot(vector, vector) * dot(other, other))


def nearest_centroid(vectors: DataFrame, centroids: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """For each vector the centroid (columns label, centroid) of the largest cosine; ties go to the smaller label.

    The centroids, one per cluster, are gathered into one array row that joins every vector.
    """
    gathered = centroids.agg(F.collect_list(F.struct("label", "centroid")).alias("_cs")).withColumn("_one", F.lit(1))
    met = vectors.withColumn("_one", F.lit(1)).join(F.broadcast(gathered), "_one")
    best = F.array_max(F.transform("_cs", lambda c: F.struct(cosine_to(F.col(vector_col), c["centroid"]).alias("cosine"), (-c["label"]).alias("minus"))))
    return met.withColumn("_best", best).select(id_col, (-F.col("_best.minus")).alias("nearest"), F.col("_best.cosine").alias("cosine"))
