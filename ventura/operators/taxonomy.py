"""Assembly of a taxonomy: firms without text take the place of those of their categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share and number of mapped firms that make a pair of categories tell a domain.
MIN_PLURALITY, MIN_SUPPORT = 0.55, 15
PENDING = "Pending enrichment"
_PLACE = ("domain", "capability", "label", "cluster")


def _modes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The most frequent value of each place column per key (ties: the smallest), and the share and number behind the domain.

    Values are counted before they meet, so a frequent pair of categories is a few rows in the second grouping.
    """
    melted = rows.select(*keys, F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in _PLACE))))
    counts = melted.filter("value IS NOT NULL").groupBy(*keys, "field", "value").agg(F.count("*").alias("n"))
    # clusters are numbers: equal counts are ordered as such
    rank = F.struct(-F.col("n"), F.when(F.col("field") == "cluster", F.col("value").cast("int")), "value")
    best = counts.groupBy(*keys, "field").agg(F.min_by("value", rank).alias("value"), F.max("n").alias("most"), F.sum("n").alias("total"))
    of = lambda field, column: F.max(F.when(F.col("field") == field, F.col(column)))
    return best.groupBy(*keys).agg(*(of(c, "value").alias(c) for c in _PLACE), of("domain", "total").alias("n"), (of("domain", "most") / of("domain", "total")).alias("plurality"))


def learned_combinations(rows: DataFrame, min_plurality: float = MIN_PLURALITY, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Pairs of (ai_application, ai_subfield) that tell a domain, from mapped hidden firms with a subfield other than ``other``."""
    taught = rows.filter("bucket = 'hidden' AND status = 'mapped' AND ai_subfield <> 'other' AND ai_application IS NOT NULL")
    return _modes(taught, ["ai_application", "ai_subfield"]).filter((F.col("plurality") >= min_plurality) & (F.col("n") >= min_support))


def promote_pending(rows: DataFrame, min_plurality: float = MIN_PLURALITY, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Pending firms get domain, capability, label and cluster of their pair of categories and status ``category_mapped``; else, of
    the application ``healthcare``, the largest cluster of mapped hidden healthcare firms, if there is one. Other rows stay.

    Rows promoted before are pending again first, so a second run gives the same. Columns: bucket, status, ai_application,
    ai_subfield, domain, capability, label, cluster; others are kept. Empty tables and null categories promote nothing.
    """
    again = F.col("status") == "category_mapped"
    waiting = F.coalesce("ai_subfield", "ai_application", F.lit("unclassified"))
    reset = {"domain": F.lit(PENDING), "label": waiting, "capability": F.lit("Other"), "cluster": F.lit(-1), "status": F.lit("pending")}
    rows = rows.withColumns({c: F.when(again, v).otherwise(F.col(c)) for c, v in reset.items()})
    good = learned_combinations(rows, min_plurality, min_support).select("ai_application", "ai_subfield", F.struct(*_PLACE).alias("_learned"))
    health = rows.filter("bucket = 'hidden' AND status = 'mapped' AND domain = 'Healthcare'")
    cells = health.groupBy("cluster", "label").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.sum("n").alias("total"), F.min_by("label", F.when(F.col("label").isNotNull(), F.struct(-F.col("n"), "label"))).alias("label"))
    largest = cells.agg(F.min_by(F.struct(F.lit("Healthcare").alias("domain"), F.lit("Other").alias("capability"), "label", F.col("cluster").cast("string").alias("cluster")), F.struct(-F.col("total"), "cluster")).alias("_health"))
    # one row, met by the firms of that application
    health_row = largest.withColumn("ai_application", F.lit("healthcare"))
    met = rows.join(good, ["ai_application", "ai_subfield"], "left").join(F.broadcast(health_row), "ai_application", "left")
    taken = F.when(F.col("status") == "pending", F.coalesce("_learned", "_health"))
    out = met.withColumn("_taken", taken)
    moved = F.col("_taken").isNotNull()
    kinds = dict(rows.dtypes)
    changed = {c: F.when(moved, F.col("_taken")[c].cast(kinds[c])).otherwise(F.col(c)) for c in _PLACE} | {"status": F.when(moved, F.lit("category_mapped")).otherwise(F.col("status"))}
    return out.withColumns(changed).select(*rows.columns)
