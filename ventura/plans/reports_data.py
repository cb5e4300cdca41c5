"""Dashboard data contracts, coverage analyses and panels over the firm model that have no report of their own elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ventura.functions import predicates as P
from ventura.functions import stats as S
from ventura.plans.aggregates import AI, BUCKET, YEAR
from ventura.plans.catalogue import plan
from ventura.plans.model import Tables
from ventura.plans.reports import _FUNDED, _CHANNEL, _funded, shares, shares_sql

_STATUS = "verification_status = 'emerging_github'"


def _tagged(t: Tables) -> DataFrame:
    return t.firm_tags.join(t.companies, F.col("company_id") == F.col("id"))


_TAGGED = "firm_tags JOIN companies ON company_id = id"


@plan("D09_research_export", f"SELECT id, name, country, region, segment, {YEAR} AS y, verification_status, ai_score FROM companies WHERE {AI}", "companies")
def d09(t: Tables) -> DataFrame:
    """All flagged firms; an export is written by its reader in the order it wants."""
    return t.companies.filter(P.is_ai()).select("id", "name", "country", "region", "segment", P.effective_year().alias("y"), "verification_status", "ai_score")


@plan("D11_filtered_companies", f"SELECT id, array_to_string(list_sort(tags), ', ') AS tags FROM companies JOIN (SELECT company_id, list(tag) AS tags FROM firm_tags GROUP BY 1 HAVING count(*) FILTER (WHERE tag LIKE 'PROMO%') > 0) ON company_id = id WHERE {AI} AND region IN ('ASIA', 'EUROPE') AND {YEAR} BETWEEN 2005 AND 2022", "companies", "firm_tags")
def d11(t: Tables) -> DataFrame:
    tags = t.firm_tags.groupBy("company_id").agg(F.collect_list("tag").alias("tags"), F.bool_or(F.startswith("tag", F.lit("PROMO"))).alias("hit")).filter("hit")
    firms = t.companies.filter(P.is_ai() & F.col("region").isin("ASIA", "EUROPE") & P.effective_year().between(2005, 2022))
    return firms.join(tags, F.col("id") == F.col("company_id")).select("id", F.array_join(F.array_sort("tags"), ", ").alias("tags"))


@plan("D12_vertical_shares", shares_sql("tag", _TAGGED), "companies", "firm_tags")
def d12(t: Tables) -> DataFrame:
    return shares(_tagged(t), "tag")


@plan("D19_country_counts", shares_sql("country", where=_STATUS, least=5), "companies")
def d19(t: Tables) -> DataFrame:
    return shares(t.companies.filter(_STATUS), "country", least=5)


@plan("D21_country_options", f"SELECT country, count(*) AS n FROM companies WHERE {_STATUS} AND country IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 60", "companies")
def d21(t: Tables) -> DataFrame:
    """The sixty commonest countries are the feature."""
    return t.companies.filter(_STATUS).filter("country IS NOT NULL").groupBy("country").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "country").limit(60)


@plan("D23_enrichment_coverage", "SELECT verification_status, count(*) AS n, count(company_id) AS enriched, round(100.0 * count(company_id) / count(*), 4)::DOUBLE AS pct FROM companies LEFT JOIN (SELECT DISTINCT company_id FROM firm_tags) ON company_id = id GROUP BY 1", "companies", "firm_tags")
def d23(t: Tables) -> DataFrame:
    keys = t.firm_tags.select("company_id").distinct()
    rows = t.companies.join(keys, F.col("id") == F.col("company_id"), "left")
    return rows.groupBy("verification_status").agg(F.count("*").alias("n"), F.count("company_id").alias("enriched")).withColumn("pct", S.pct(F.col("enriched"), F.col("n"), 4))


@plan("D24_tag_year_curve", f"SELECT tag, {YEAR} AS y, count(*) AS n FROM {_TAGGED} WHERE {YEAR} IS NOT NULL GROUP BY 1, 2", "companies", "firm_tags")
def d24(t: Tables) -> DataFrame:
    return _tagged(t).filter(P.effective_year().isNotNull()).groupBy("tag", P.effective_year().alias("y")).agg(F.count("*").alias("n"))


@plan("D27_inventory", "SELECT difficulty, status, count(*) AS n FROM runs GROUP BY 1, 2", "runs")
def d27(t: Tables) -> DataFrame:
    return t.runs.groupBy("difficulty", "status").agg(F.count("*").alias("n"))


@plan("D29_classification_counts", f"SELECT coalesce(incubator_source, 'unclassified') AS label, count(*) AS n FROM companies WHERE {_STATUS} GROUP BY 1", "companies")
def d29(t: Tables) -> DataFrame:
    return t.companies.filter(_STATUS).groupBy(F.coalesce("incubator_source", F.lit("unclassified")).alias("label")).agg(F.count("*").alias("n"))


@plan("D31_monthly_discovery", "SELECT strftime(deal_date, '%Y-%m') AS month, count(DISTINCT company_id) AS firms FROM deals GROUP BY 1 ORDER BY 1 DESC LIMIT 24", "deals")
def d31(t: Tables) -> DataFrame:
    """The last 24 months are the feature."""
    return t.deals.groupBy(F.date_format("deal_date", "yyyy-MM").alias("month")).agg(F.countDistinct("company_id").alias("firms")).orderBy(F.desc("month")).limit(24)


@plan("D32_recent_mean_by_country", f"SELECT country, round(avg(n), 6) AS mean_recent FROM (SELECT country, {YEAR} AS y, count(*) FILTER (WHERE {AI}) AS n FROM companies WHERE {YEAR} >= 2020 GROUP BY 1, 2) GROUP BY 1", "companies")
def d32(t: Tables) -> DataFrame:
    """The order of the heat map's rows: mean over the years from 2020 on."""
    cells = t.companies.filter(P.effective_year() >= 2020).groupBy("country", P.effective_year().alias("y")).agg(F.count_if(P.is_ai()).alias("n"))
    return cells.groupBy("country").agg(F.round(F.avg("n"), 6).alias("mean_recent"))


@plan("D35_last_run_per_tier", "SELECT difficulty, max(finished_at) AS last_run, count(DISTINCT site) AS sites, count(*) FILTER (WHERE status = 'success') AS ok FROM runs GROUP BY 1", "runs")
def d35(t: Tables) -> DataFrame:
    return t.runs.groupBy("difficulty").agg(F.max("finished_at").alias("last_run"), F.countDistinct("site").alias("sites"), F.count_if(F.col("status") == "success").alias("ok"))


@plan("D36_split_frames", f"SELECT CASE WHEN {_STATUS} THEN 'code host' ELSE 'scraper' END AS frame, count(*) AS n, count(domain) AS with_domain, count({YEAR}) AS with_year FROM companies GROUP BY 1", "companies")
def d36(t: Tables) -> DataFrame:
    frame = F.when(F.expr(_STATUS), "code host").otherwise("scraper")
    return t.companies.groupBy(frame.alias("frame")).agg(F.count("*").alias("n"), F.count("domain").alias("with_domain"), F.count(P.effective_year()).alias("with_year"))


@plan("D38_snapshot", "SELECT count(*) AS runs, count(*) FILTER (WHERE finished_at > latest - INTERVAL 7 DAY) AS week, count(DISTINCT site) FILTER (WHERE finished_at > latest - INTERVAL 7 DAY) AS sites FROM runs, (SELECT max(finished_at) AS latest FROM runs)", "runs")
def d38(t: Tables) -> DataFrame:
    """Anchored on the data's own last moment, one row that is broadcast."""
    latest = t.runs.agg(F.max("finished_at").alias("latest"))
    rows = t.runs.withColumn("one", F.lit(1)).join(F.broadcast(latest.withColumn("one", F.lit(1))), "one")
    recent = F.col("finished_at") > F.col("latest") - F.expr("INTERVAL 7 DAYS")
    return rows.agg(F.count("*").alias("runs"), F.count_if(recent).alias("week"), F.countDistinct(F.when(recent, F.col("site"))).alias("sites"))


@plan("E05_score_distribution", "SELECT b AS bucket, count(score) AS n FROM range(0, 10) AS r(b) LEFT JOIN (SELECT least(9, CAST(floor(ai_score * 10) AS BIGINT)) AS score FROM companies WHERE ai_score BETWEEN 0 AND 1) ON score = b GROUP BY 1", "companies")
def e05(t: Tables) -> DataFrame:
    """Ten buckets, empty ones included; a score of 1 is in the last."""
    score = F.least(F.lit(9).cast("long"), F.floor(F.col("ai_score") * 10).cast("long"))
    found = t.companies.filter(F.col("ai_score").between(0, 1)).groupBy(score.alias("bucket")).agg(F.count("*").alias("n"))
    return t.spark.range(10).select(F.col("id").alias("bucket")).join(F.broadcast(found), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


_Z = "1.959963984540054"


@plan("K02_gap_tests", f"""
SELECT bucket, n, ai, round(a * d / (b * c), 8) AS odds, round(exp(ln(a * d / (b * c)) - {_Z} * sqrt(1 / a + 1 / b + 1 / c + 1 / d)), 8) AS lo, round(exp(ln(a * d / (b * c)) + {_Z} * sqrt(1 / a + 1 / b + 1 / c + 1 / d)), 8) AS hi
FROM (SELECT bucket, n, ai, ai + h AS a, n - ai + h AS b, rai + h AS c, rn - rai + h AS d FROM (SELECT *, CASE WHEN 0 IN (ai, n - ai, rai, rn - rai) THEN 0.5 ELSE 0 END::DOUBLE AS h
  FROM (SELECT {BUCKET} AS bucket, count(*) AS n, count(*) FILTER (WHERE {AI}) AS ai FROM companies GROUP BY 1) o, (SELECT count(*) AS rn, count(*) FILTER (WHERE {AI}) AS rai FROM companies WHERE {BUCKET} = 'A') r WHERE bucket <> 'A'))""", "companies")
def k02(t: Tables) -> DataFrame:
    """Odds of each bucket against database A, the counts of which are one row."""
    rows = t.companies.groupBy(P.coverage_bucket().alias("bucket")).agg(F.count("*").alias("n"), F.count_if(P.is_ai()).alias("ai")).withColumn("one", F.lit(1))
    reference = rows.filter("bucket = 'A'").select("one", F.col("n").alias("rn"), F.col("ai").alias("rai"))
    odds, lo, hi = S.odds_ratio(F.col("ai"), F.col("n"), F.col("rai"), F.col("rn"))
    return rows.filter("bucket <> 'A'").join(F.broadcast(reference), "one").select("bucket", "n", "ai", F.round(odds, 8).alias("odds"), F.round(lo, 8).alias("lo"), F.round(hi, 8).alias("hi"))


@plan("K50_name_collisions", "SELECT name, count(DISTINCT domain) AS domains, count(*) AS firms FROM (SELECT domain, split_part(domain, '.', 1)[1:6] AS name FROM companies WHERE domain IS NOT NULL) GROUP BY 1 HAVING count(DISTINCT domain) > 1", "companies")
def k50(t: Tables) -> DataFrame:
    """Short names that more than one domain bears."""
    rows = t.companies.filter("domain IS NOT NULL").select("domain", F.left(F.split_part("domain", F.lit("."), F.lit(1)), F.lit(6)).alias("name"))
    return rows.groupBy("name").agg(F.countDistinct("domain").alias("domains"), F.count("*").alias("firms")).filter("domains > 1")


_THRESHOLDS = (0.1, 0.25, 0.5, 0.75, 0.9)


@plan("K53_threshold_sweep", "SELECT threshold, count(*) FILTER (WHERE ai_score >= threshold) AS flagged, count(*) FILTER (WHERE ai_score >= threshold AND llm_ai_verified) AS right_ones FROM companies, (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9])::DOUBLE AS threshold) GROUP BY 1", "companies")
def k53(t: Tables) -> DataFrame:
    """One scan: the thresholds are counted side by side, then turned into rows."""
    s, good = F.col("ai_score"), F.col("llm_ai_verified")
    cells = t.companies.agg(*(F.struct(F.lit(x).alias("threshold"), F.count_if(s >= x).alias("flagged"), F.count_if((s >= x) & good).alias("right_ones")).alias(f"t{k}") for k, x in enumerate(_THRESHOLDS)))
    return cells.select(F.inline(F.array(*(f"t{k}" for k in range(len(_THRESHOLDS))))))


@plan("K62_performance_by_bucket", f"SELECT bucket, tp, fp, fn, round(tp::DOUBLE / nullif(tp + fp, 0), 8) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 8) AS recall FROM (SELECT {BUCKET} AS bucket, count(*) FILTER (WHERE p AND llm_ai_verified) AS tp, count(*) FILTER (WHERE p AND NOT llm_ai_verified) AS fp, count(*) FILTER (WHERE NOT p AND llm_ai_verified) AS fn FROM (SELECT *, ai_score >= 0.5 AS p FROM companies WHERE ai_score IS NOT NULL AND llm_ai_verified IS NOT NULL) GROUP BY 1)", "companies")
def k62(t: Tables) -> DataFrame:
    known = t.companies.filter("ai_score IS NOT NULL AND llm_ai_verified IS NOT NULL")
    p, y = F.col("ai_score") >= 0.5, F.col("llm_ai_verified")
    cells = known.groupBy(P.coverage_bucket().alias("bucket")).agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"))
    precision, recall, _ = S.precision_recall(F.col("tp"), F.col("fp"), F.col("fn"))
    return cells.select("bucket", "tp", "fp", "fn", F.round(precision, 8).alias("precision"), F.round(recall, 8).alias("recall"))


@plan("K32_location_quotient", f"""
SELECT region, segment, n, round((n::DOUBLE / sum(n) OVER (PARTITION BY region)) / (sum(n) OVER (PARTITION BY segment)::DOUBLE / sum(n) OVER ()), 8) AS lq FROM (SELECT region, segment, count(*) AS n FROM companies WHERE {AI} GROUP BY 1, 2)""", "companies")
def k32(t: Tables) -> DataFrame:
    """Windows over the few aggregated cells."""
    cells = t.companies.filter(P.is_ai()).groupBy("region", "segment").agg(F.count("*").alias("n"))
    over = lambda *keys: F.sum("n").over(Window.partitionBy(*keys)).cast("double")
    return cells.withColumn("lq", F.round((F.col("n") / over("region")) / (over("segment") / over()), 8))


@plan("K05b_leave_one_out_support", f"""
SELECT left_out, n, ai, round(100.0 * ai / n, 4)::DOUBLE AS ai_pct FROM (SELECT c.channel AS left_out, sum(n) FILTER (WHERE r.channel <> c.channel) AS n, sum(ai) FILTER (WHERE r.channel <> c.channel) AS ai
FROM (SELECT {_CHANNEL} AS channel, count(*) AS n, count(*) FILTER (WHERE {AI}) AS ai FROM {_FUNDED} WHERE ai_score IS NOT NULL GROUP BY 1) r, (SELECT DISTINCT {_CHANNEL} AS channel FROM {_FUNDED} WHERE ai_score IS NOT NULL) c GROUP BY 1)""", "companies", "deals")
def k05b(t: Tables) -> DataFrame:
    """Firms with a score alone; what is left is the total without the channel's own."""
    cells = _funded(t).filter("ai_score IS NOT NULL").groupBy(P.channel(F.col("funded")).alias("left_out")).agg(F.count("*").alias("own"), F.count_if(P.is_ai()).alias("own_ai"))
    total = lambda c: F.sum(c).over(Window.partitionBy())
    rows = cells.select("left_out", (total("own") - F.col("own")).alias("n"), (total("own_ai") - F.col("own_ai")).alias("ai"))
    return rows.withColumn("ai_pct", S.pct(F.col("ai"), F.col("n"), 4))
