"""Upserts and merges as pure functions from DataFrames to a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ventura.operators.joins import top_per_key


def escalate(old: Column, new: Column) -> Column:
    """Verification status after a new source; it never goes down."""
    rank = lambda c: F.when(c == "verified_cb_pb", 3).when(c.isin("verified_cb", "verified_pb"), 2).when(c == "emerging_github", 1).otherwise(0)
    both = ((old == "verified_cb") & (new == "verified_pb")) | ((old == "verified_pb") & (new == "verified_cb"))
    return F.when(both, "verified_cb_pb").when(rank(new) > rank(old), new).otherwise(F.coalesce(old, new))


def upsert(old: DataFrame, new: DataFrame, key: str, rules: dict[str, str], default: str = "old") -> DataFrame:
    """Full outer merge on ``key``; per column ``old`` or ``new`` wins if not null, or ``greatest``, ``or``, ``status``,
    ``new_text`` (new unless null or empty). Both sides hold one row per key; null keys never match."""
    o, n = old.alias("o"), new.alias("n")
    met = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    columns = [F.coalesce(f"o.{key}", f"n.{key}").alias(key)]
    for c in (c for c in old.columns if c != key):
        if c not in new.columns:
            columns.append(F.col(f"o.{c}").alias(c))
            continue
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        made = {
            "old": lambda: F.coalesce(a, b),
            "new": lambda: F.coalesce(b, a),
            "greatest": lambda: F.greatest(a, b),
            "or": lambda: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)),
            "status": lambda: escalate(a, b),
            "new_text": lambda: F.coalesce(F.nullif(b, F.lit("")), a),
            "map": lambda: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)),
        }[rules.get(c, default)]
        columns.append(made().alias(c))
    return met.select(*columns)


def batch_best(df: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    """One row per lower-cased key: the highest score, then the smallest ``tie``; rows without a key stay."""
    keyed = df.filter(F.col(key).isNotNull()).withColumn("_k", F.lower(key))
    return top_per_key(keyed, ["_k"], [F.desc_nulls_last(score), F.col(tie)]).drop("_k").unionByName(df.filter(F.col(key).isNull()))


def insert_new(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` whose null-safe key isn't in ``target``, one per key by all columns."""
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    condition = on[0]
    for c in on[1:]:
        condition &= c
    fresh = rows.alias("r").join(target.select(*keys).distinct().alias("t"), condition, "left_anti")
    return target.unionByName(top_per_key(fresh, keys, [F.col(c) for c in rows.columns]))


def fill_missing(target: DataFrame, values: DataFrame, key: str, column: str, overwrite: bool = False) -> DataFrame:
    """UPDATE ... FROM values where the target is null, or everywhere a value is given with ``overwrite``."""
    v = values.select(F.col(key).alias("_k"), F.col(column).alias("_v"))
    out = target.join(v, F.col(key) == F.col("_k"), "left")
    made = F.coalesce("_v", column) if overwrite else F.coalesce(column, "_v")
    return out.withColumn(column, made).drop("_k", "_v")


def merge_duplicates(firms: DataFrame, signals: DataFrame, group: Column) -> tuple[DataFrame, DataFrame]:
    """Merge firms of one group into that with the most signals, then score, then smallest id.

    Returns the merged firms and the signals pointed to them. ``group`` must not be null for rows to merge.
    """
    counts = signals.groupBy("company_id").agg(F.count("*").alias("n_signals"))
    rows = firms.withColumn("_g", group).join(counts, F.col("id") == F.col("company_id"), "left").drop("company_id")
    order = F.struct(F.coalesce("n_signals", F.lit(0)), F.coalesce("ai_score", F.lit(-1.0)), -F.col("id"))
    grouped = rows.filter("_g IS NOT NULL").groupBy("_g").agg(
        F.max_by("id", order).alias("id"), F.max("ai_score").alias("ai_score"), F.min("founded_year").alias("founded_year"), F.max_by("name", order).alias("name"), F.count("*").alias("merged")
    )
    canonical = rows.filter("_g IS NOT NULL").select(F.col("id").alias("company_id"), "_g").join(grouped.select("_g", F.col("id").alias("keep_id")), "_g").drop("_g")
    moved = signals.join(canonical, "company_id", "left").withColumn("company_id", F.coalesce("keep_id", "company_id")).drop("keep_id")
    return grouped.drop("_g"), moved


def candidate_dedup(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """First row per key by ``order`` with the largest ``stars`` and the union of ``urls``; rows without a key stay."""
    keyed = rows.withColumn("_key", key)
    first = keyed.filter("_key IS NOT NULL").groupBy("_key").agg(
        F.min(order).alias(order), F.min_by("name", order).alias("name"), F.max("stars").alias("stars"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("urls")))).alias("urls")
    )
    return first.drop("_key").unionByName(keyed.filter("_key IS NULL").select(order, "name", "stars", F.array_sort(F.array_distinct("urls")).alias("urls")))


def validate_batch(records: DataFrame, run: str, name: str) -> DataFrame:
    """Per run: valid-name ratio, duplicate ratio, completeness score and verdict."""
    valid = F.coalesce(F.length(F.trim(name)) >= 2, F.lit(False))
    out = records.groupBy(run).agg(F.count("*").alias("n"), F.count_if(valid).alias("valid"), F.countDistinct(F.lower(F.trim(name))).alias("names"))
    out = out.withColumn("valid_ratio", F.col("valid") / F.col("n")).withColumn("duplicate_ratio", 1 - F.col("names") / F.col("n"))
    score = 0.4 + 0.4 * F.col("valid_ratio") + 0.2 * (1 - F.col("duplicate_ratio"))
    return out.withColumn("score", F.round(score, 6)).withColumn("is_good", (F.col("n") >= 5) & (F.col("valid_ratio") >= 0.6) & (F.col("duplicate_ratio") <= 0.4))
