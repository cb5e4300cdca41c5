"""Named predicates and buckets as Columns. Variants differ on purpose; none is corrected into another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(alias: str | None, name: str) -> Column:
    return F.col(f"{alias}.{name}" if alias else name)


def is_ai(alias: str | None = None) -> Column:
    """The canonical predicate; null where nothing is true and the score or the verdict is unknown."""
    return _c(alias, "cb_ai_tagged") | (_c(alias, "ai_score") >= 0.5) | _c(alias, "ai_mentioned") | _c(alias, "llm_ai_verified")


def ai_variants(alias: str | None = None) -> dict[str, Column]:
    tag, score, mention, verdict = (_c(alias, c) for c in ("cb_ai_tagged", "ai_score", "ai_mentioned", "llm_ai_verified"))
    return {
        "canonical": is_ai(alias),
        "no_mention": tag | (score >= 0.5) | verdict,
        "pre_llm": tag | (score >= 0.5) | mention,
        "mention": mention,
        "evidence": tag | verdict,
    }


def coverage_bucket(alias: str | None = None) -> Column:
    """Two databases and the rest; firms in both count as unlisted here."""
    status = _c(alias, "verification_status")
    return F.when(status == "verified_cb", "A").when(status == "verified_pb", "B").otherwise("Unlisted")


def strict_bucket(alias: str | None = None) -> Column:
    """As ``coverage_bucket``, with firms in both databases apart."""
    status = _c(alias, "verification_status")
    return F.when(status == "verified_cb_pb", "both").when(status == "verified_cb", "cb_only").when(status == "verified_pb", "pb_only").otherwise("hidden")


def channel(has_deal: Column, alias: str | None = None) -> Column:
    """Where a firm came from; the first that holds."""
    return F.when(has_deal, "financing").when(_c(alias, "naics_code").isNotNull(), "grants").when(_c(alias, "incubator_source") == "accelerator", "accelerator").otherwise("other")


def effective_year(alias: str | None = None) -> Column:
    """Founding year, else cohort, first grant or first sight on the web (0 means unknown)."""
    return F.coalesce(*(_c(alias, c) for c in ("founded_year", "cohort_year", "grant_first_award_year")), F.nullif(_c(alias, "web_first_seen_year"), F.lit(0)))


def cohort_band(year: Column) -> Column:
    """Right-closed bands."""
    return F.when(year <= 2009, "<=2009").when(year <= 2014, "2010-14").when(year <= 2019, "2015-19").when(year <= 2100, "2020+")


def stage_bucket(round_type: Column) -> Column:
    return F.when(round_type.startswith("1") | round_type.startswith("2"), "early").when(round_type.startswith("3"), "mid").otherwise("late")
