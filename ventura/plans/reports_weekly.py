"""Matrix, momentum, cohort windows, weekly brief and scoped answers: the last dashboard contracts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ventura.functions import predicates as P
from ventura.functions import stats as S
from ventura.plans.aggregates import AI, BUCKET, YEAR
from ventura.plans.catalogue import plan
from ventura.plans.model import Tables


@plan("D08_country_year_top", f"SELECT country, founded_year, count(*) AS total, count(*) FILTER (WHERE {AI}) AS ai, round(100.0 * count(*) FILTER (WHERE {AI}) / count(*), 4)::DOUBLE AS ai_pct FROM companies WHERE founded_year BETWEEN 2010 AND 2026 AND country IN (SELECT country FROM companies WHERE country <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 25) GROUP BY 1, 2", "companies")
def d08(t: Tables) -> DataFrame:
    """Years of the 25 largest countries, which are the feature."""
    top = t.companies.filter("country <> ''").groupBy("country").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "country").limit(25).select("country")
    rows = t.companies.filter("founded_year BETWEEN 2010 AND 2026").join(F.broadcast(top), "country", "left_semi")
    cells = rows.groupBy("country", "founded_year").agg(F.count("*").alias("total"), F.count_if(P.is_ai()).alias("ai"))
    return cells.withColumn("ai_pct", S.pct(F.col("ai"), F.col("total"), 4))


_FIRST = "SELECT company_id AS firm, min(deal_date) AS seen FROM deals GROUP BY 1"


@plan("D26_fastest_tags", f"""
SELECT tag, total, new, old, CASE WHEN old > 0 THEN round(100.0 * (new - old) / old, 6) WHEN new > 0 THEN 100.0 ELSE 0.0 END::DOUBLE AS growth FROM (
  SELECT tag, count(*) AS total, count(*) FILTER (WHERE seen >= latest - INTERVAL 30 DAY) AS new, count(*) FILTER (WHERE seen >= latest - INTERVAL 60 DAY AND seen < latest - INTERVAL 30 DAY) AS old
  FROM firm_tags JOIN companies ON company_id = id JOIN ({_FIRST}) ON firm = id, (SELECT max(seen) AS latest FROM ({_FIRST})) WHERE ai_score >= 0.5 OR cb_ai_tagged GROUP BY 1) ORDER BY new DESC, tag LIMIT 15""", "companies", "deals", "firm_tags")
def d26(t: Tables) -> DataFrame:
    """The fifteen tags with most firms first seen in the data's last 30 days, against the 30 before."""
    first = t.deals.groupBy(F.col("company_id").alias("firm")).agg(F.min("deal_date").alias("seen"))
    latest = first.agg(F.max("seen").alias("latest")).withColumn("one", F.lit(1))
    flagged = t.companies.filter((F.col("ai_score") >= 0.5) | F.col("cb_ai_tagged")).join(first, F.col("firm") == F.col("id"))
    flagged = flagged.select("id", "seen", F.lit(1).alias("one")).join(F.broadcast(latest), "one")
    month, two = F.col("latest") - F.expr("INTERVAL 30 DAYS"), F.col("latest") - F.expr("INTERVAL 60 DAYS")
    seen = F.col("seen")
    cells = t.firm_tags.join(flagged, F.col("company_id") == F.col("id")).groupBy("tag").agg(F.count("*").alias("total"), F.count_if(seen >= month).alias("new"), F.count_if((seen >= two) & (seen < month)).alias("old"))
    growth = F.when(F.col("old") > 0, F.round(100.0 * (F.col("new") - F.col("old")) / F.col("old"), 6)).when(F.col("new") > 0, 100.0).otherwise(0.0)
    return cells.withColumn("growth", growth).orderBy(F.desc("new"), "tag").limit(15)


@plan("D30_site_tiers", """
SELECT tier, count(*) AS sites, sum(ok) AS successes FROM (SELECT site, count(*) FILTER (WHERE status = 'success') AS ok,
  CASE WHEN count(*) FILTER (WHERE status = 'success') = 0 THEN 'unscrapeable' WHEN arg_max(status, (finished_at, event_id)) = 'error' THEN 'failing' WHEN max(difficulty) = 'hard' THEN 'hard' ELSE 'easy' END AS tier FROM runs GROUP BY 1) GROUP BY 1""", "runs")
def d30(t: Tables) -> DataFrame:
    """Inventory of sites by tier: never read, failing at the last run, else by difficulty."""
    sites = t.runs.groupBy("site").agg(F.count_if(F.col("status") == "success").alias("ok"), F.max_by("status", F.struct("finished_at", "event_id")).alias("last"), F.max("difficulty").alias("difficulty"))
    tier = F.when(F.col("ok") == 0, "unscrapeable").when(F.col("last") == "error", "failing").otherwise(F.col("difficulty"))
    return sites.groupBy(tier.alias("tier")).agg(F.count("*").alias("sites"), F.sum("ok").alias("successes"))


_YEARS = f"SELECT founded_year AS y, count(*) AS n FROM companies WHERE {AI} AND founded_year >= 2010 GROUP BY 1"
_JUDGED = f"SELECT a.y, a.n, (SELECT count(*) FROM ({_YEARS}) b WHERE b.y BETWEEN a.y - 3 AND a.y - 1) AS k, (SELECT median(b.n) FROM ({_YEARS}) b WHERE b.y BETWEEN a.y - 3 AND a.y - 1) AS m FROM ({_YEARS}) a"
_LAST = f"SELECT coalesce(CASE WHEN (SELECT k FROM ({_JUDGED}) WHERE y = stop) < 3 THEN (SELECT min(y) - 1 FROM ({_JUDGED}) WHERE y > stop) END, stop) AS last_complete FROM (SELECT max(y) AS stop FROM ({_JUDGED}) WHERE k < 3 OR n >= 0.5 * m)"


def _formation(t: Tables) -> DataFrame:
    """Flagged firms by founding year, each year judged by the median of the three before; windows over a few years only."""
    years = t.companies.filter(P.is_ai() & (F.col("founded_year") >= 2010)).groupBy(F.col("founded_year").alias("y")).agg(F.count("*").alias("n"))
    before = Window.orderBy("y").rangeBetween(-3, -1)
    judged = years.select("y", "n", F.count("*").over(before).alias("k"), F.percentile("n", 0.5).over(before).alias("m"))
    whole = Window.partitionBy()
    judged = judged.withColumn("stop", F.max(F.when((F.col("k") < 3) | (F.col("n") >= 0.5 * F.col("m")), F.col("y"))).over(whole))
    short = F.max(F.when((F.col("y") == F.col("stop")) & (F.col("k") < 3), True)).over(whole)
    above = F.min(F.when(F.col("y") > F.col("stop"), F.col("y"))).over(whole) - 1
    return judged.withColumn("last_complete", F.coalesce(F.when(short, above), F.col("stop")))


@plan("D40_formation", f"SELECT y, n, last_complete, y > last_complete AS provisional FROM ({_YEARS}), ({_LAST})", "companies")
def d40(t: Tables) -> DataFrame:
    """A trailing year with less than half the median of the three before it is provisional: its records haven't landed yet."""
    return _formation(t).select("y", "n", "last_complete", (F.col("y") > F.col("last_complete")).alias("provisional"))


@plan("D41_cohort_windows", f"SELECT last_complete - 2 AS recent_from, last_complete AS recent_to, last_complete - 5 AS prior_from, last_complete - 3 AS prior_to FROM ({_LAST})", "companies")
def d41(t: Tables) -> DataFrame:
    """The two windows of three years that momentum figures use; one row, null without years."""
    last = _formation(t).agg(F.max("last_complete").alias("y"))
    return last.select((F.col("y") - 2).alias("recent_from"), F.col("y").alias("recent_to"), (F.col("y") - 5).alias("prior_from"), (F.col("y") - 3).alias("prior_to"))


_HIDDEN = f"{BUCKET} = 'Unlisted'"


@plan("D49_weekly_brief", f"""
WITH w AS (SELECT {YEAR} AS y, tag, id FROM firm_tags JOIN companies ON company_id = id WHERE {AI}),
 s AS (SELECT tag, 100.0 * count(*) FILTER (WHERE y BETWEEN 2020 AND 2022) / (SELECT count(*) FROM companies WHERE {AI} AND {YEAR} BETWEEN 2020 AND 2022) AS recent, 100.0 * count(*) FILTER (WHERE y BETWEEN 2017 AND 2019) / (SELECT count(*) FROM companies WHERE {AI} AND {YEAR} BETWEEN 2017 AND 2019) AS prior FROM w GROUP BY 1)
SELECT 'lead' AS kicker, CAST(NULL AS VARCHAR) AS label, round(100.0 * count(*) FILTER (WHERE {_HIDDEN}) / count(*), 4)::DOUBLE AS figure FROM companies WHERE id IN (SELECT firm FROM ({_FIRST}) WHERE seen > (SELECT max(seen) FROM ({_FIRST})) - INTERVAL 7 DAY)
UNION ALL SELECT * FROM (SELECT 'sectors', tag, round(100 * (recent / prior - 1), 6)::DOUBLE FROM s WHERE prior > 0 ORDER BY round(100 * (recent / prior - 1), 6) DESC, tag LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'geography', country, count(*)::DOUBLE FROM companies WHERE {AI} AND region <> 'AMERICA' AND {YEAR} BETWEEN 2020 AND 2022 GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 1)
UNION ALL SELECT 'discovery', NULL, count(*)::DOUBLE FROM companies WHERE verification_status = 'emerging_github'""", "companies", "deals", "firm_tags")
def d49(t: Tables) -> DataFrame:
    """One row per brief: hidden share of the last week's arrivals, top category by change of share, top place abroad, finds on code hosts.

    Each brief picks one row of an aggregate, so the picks are of the feature's size.
    """
    y, firms = P.effective_year(), t.companies
    recent, prior = y.between(2020, 2022), y.between(2017, 2019)
    row = lambda df, kicker, label, figure: df.select(F.lit(kicker).alias("kicker"), label.cast("string").alias("label"), figure.cast("double").alias("figure"))
    first = t.deals.groupBy(F.col("company_id").alias("id")).agg(F.min("deal_date").alias("seen"))
    latest = first.agg(F.max("seen").alias("latest")).withColumn("one", F.lit(1))
    week = first.withColumn("one", F.lit(1)).join(F.broadcast(latest), "one").filter(F.col("seen") > F.col("latest") - F.expr("INTERVAL 7 DAYS"))
    arrivals = firms.join(week.select("id"), "id", "left_semi").agg(F.count("*").alias("n"), F.count_if(P.coverage_bucket() == "Unlisted").alias("hidden"))
    flagged = firms.filter(P.is_ai())
    totals = flagged.agg(F.count_if(recent).alias("r_all"), F.count_if(prior).alias("p_all")).withColumn("one", F.lit(1))
    tags = t.firm_tags.join(flagged, F.col("company_id") == F.col("id")).groupBy("tag").agg(F.count_if(recent).alias("r"), F.count_if(prior).alias("p")).filter("p > 0")
    share = lambda part, whole: 100.0 * F.col(part) / F.col(whole)
    moved = tags.withColumn("one", F.lit(1)).join(F.broadcast(totals), "one").withColumn("change", F.round(100 * (share("r", "r_all") / share("p", "p_all") - 1), 6))
    abroad = flagged.filter((F.col("region") != "AMERICA") & recent).groupBy("country").agg(F.count("*").alias("n"))
    briefs = [
        row(arrivals, "lead", F.lit(None), S.pct(F.col("hidden"), F.col("n"), 4)),
        row(moved.orderBy(F.desc("change"), "tag").limit(1), "sectors", F.col("tag"), F.col("change")),
        row(abroad.orderBy(F.desc("n"), "country").limit(1), "geography", F.col("country"), F.col("n")),
        row(firms.filter("verification_status = 'emerging_github'").agg(F.count("*").alias("n")), "discovery", F.lit(None), F.col("n")),
    ]
    return reduce(DataFrame.unionAll, briefs)


_SCOPE = f"SELECT * FROM companies WHERE region = 'ASIA' AND {AI}"


@plan("D53_answer", f"""
SELECT 'total' AS part, CAST(NULL AS VARCHAR) AS key, count(*) AS n FROM ({_SCOPE}) UNION ALL SELECT 'hidden', NULL, count(*) FROM ({_SCOPE}) WHERE {_HIDDEN}
UNION ALL SELECT 'series', CAST({YEAR} AS VARCHAR), count(*) FROM ({_SCOPE}) WHERE {YEAR} IS NOT NULL GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'ranking', tag, count(*) FROM firm_tags JOIN ({_SCOPE}) ON company_id = id GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5)
UNION ALL SELECT 'basis', 'with a year', count({YEAR}) FROM ({_SCOPE})""", "companies", "firm_tags")
def d53(t: Tables) -> DataFrame:
    """A scope's answer in long form: totals, series by year, its five commonest tags, and what the series rests on.

    Totals and series come from one grouping of the scope by year.
    """
    scope = t.companies.filter((F.col("region") == "ASIA") & P.is_ai())
    years = scope.groupBy(P.effective_year().alias("y")).agg(F.count("*").alias("n"), F.count_if(P.coverage_bucket() == "Unlisted").alias("hidden"))
    nothing = F.lit(None).cast("string")
    sums = years.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("hidden"), F.lit(0)).alias("hidden"), F.coalesce(F.sum(F.when(F.col("y").isNotNull(), F.col("n"))), F.lit(0)).alias("dated"))
    cell = lambda part, key, n: F.struct(F.lit(part).alias("part"), key.alias("key"), n.alias("n"))
    totals = sums.select(F.inline(F.array(cell("total", nothing, F.col("n")), cell("hidden", nothing, F.col("hidden")), cell("basis", F.lit("with a year"), F.col("dated")))))
    series = years.filter("y IS NOT NULL").select(F.lit("series").alias("part"), F.col("y").cast("string").alias("key"), "n")
    tags = t.firm_tags.join(scope, F.col("company_id") == F.col("id"), "left_semi").groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(5)
    return totals.unionAll(series).unionAll(tags.select(F.lit("ranking").alias("part"), F.col("tag").alias("key"), "n"))
