"""Further named reports: longitudinal panels, novelty, imputation, resolution, dashboard panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ventura.functions import predicates as P
from ventura.functions import stats as S
from ventura.operators.joins import top_per_key
from ventura.plans.aggregates import AI, BUCKET, YEAR
from ventura.plans.catalogue import plan
from ventura.plans.model import Tables
from ventura.plans.reports import _CHANNEL, _FUNDED, BAND, _deals, _funded, shares, shares_sql
from ventura.plans.statistics import wilson_sql

HIDDEN = f"{BUCKET} = 'Unlisted'"


def hidden(t: Tables) -> DataFrame:
    return t.companies.filter(P.coverage_bucket() == "Unlisted")


@plan("Q19_application_mix", f"SELECT segment, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4)::DOUBLE AS share FROM companies WHERE {AI} AND {HIDDEN} GROUP BY 1", "companies")
def q19(t: Tables) -> DataFrame:
    rows = hidden(t).filter(P.is_ai()).groupBy("segment").agg(F.count("*").alias("n"))
    return rows.withColumn("share", S.pct(F.col("n"), F.sum("n").over(Window.partitionBy()), 4))


@plan("Q21_application_trends", f"SELECT {BAND} AS band, segment, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY {BAND}), 4)::DOUBLE AS share FROM companies WHERE {AI} GROUP BY 1, 2", "companies")
def q21(t: Tables) -> DataFrame:
    rows = t.companies.filter(P.is_ai()).groupBy(P.cohort_band(P.effective_year()).alias("band"), "segment").agg(F.count("*").alias("n"))
    return rows.withColumn("share", S.pct(F.col("n"), F.sum("n").over(Window.partitionBy("band")), 4))


@plan("Q22_repackaging_summary", f"SELECT cb_ai_tagged AS before, ai_mentioned AS after, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS share, round(avg(total_raised), 2) AS mean_raised FROM companies GROUP BY 1, 2", "companies")
def q22(t: Tables) -> DataFrame:
    rows = t.companies.groupBy(F.col("cb_ai_tagged").alias("before"), F.col("ai_mentioned").alias("after")).agg(F.count("*").alias("n"), F.round(F.avg("total_raised"), 2).alias("mean_raised"))
    return rows.withColumn("share", F.col("n").cast("double") / F.sum("n").over(Window.partitionBy()))


@plan("Q36_cohort_identity", f"SELECT {BAND} AS band, count(*) FILTER (WHERE NOT cb_ai_tagged AND ai_mentioned) AS added, count(*) FILTER (WHERE NOT cb_ai_tagged) AS base FROM companies GROUP BY 1", "companies")
def q36(t: Tables) -> DataFrame:
    before, after = F.col("cb_ai_tagged"), F.col("ai_mentioned")
    return t.companies.groupBy(P.cohort_band(P.effective_year()).alias("band")).agg(F.count_if(~before & after).alias("added"), F.count_if(~before).alias("base"))


@plan("Q37_description_change", "SELECT source, count(*) AS n, count(*) FILTER (WHERE length(text) > 1500) AS rewritten FROM documents GROUP BY 1")
def q37(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.length("text") > 1500).alias("rewritten"))


@plan("Q38_term_surge", "SELECT term, count(*) FILTER (WHERE doc_id % 2 = 0 AND contains(lower(text), term)) AS early, count(*) FILTER (WHERE doc_id % 2 = 1 AND contains(lower(text), term)) AS late FROM documents, (SELECT unnest(['token', 'license', 'the ', 'und ']) AS term) GROUP BY 1")
def q38(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.lower("text").alias("low"), F.explode(F.array(*map(F.lit, ("token", "license", "the ", "und ")))).alias("term"))
    hit = F.contains("low", "term")
    return rows.groupBy("term").agg(F.count_if((F.col("doc_id") % 2 == 0) & hit).alias("early"), F.count_if((F.col("doc_id") % 2 == 1) & hit).alias("late"))


@plan("Q40_verdict_summary", "SELECT verdict, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4)::DOUBLE AS share FROM (SELECT CASE WHEN llm_ai_verified THEN 'genuine' WHEN NOT llm_ai_verified THEN 'label' ELSE 'unclear' END AS verdict FROM companies WHERE ai_mentioned) GROUP BY 1", "companies")
def q40(t: Tables) -> DataFrame:
    v = F.col("llm_ai_verified")
    rows = t.companies.filter("ai_mentioned").groupBy(F.when(v, "genuine").when(~v, "label").otherwise("unclear").alias("verdict")).agg(F.count("*").alias("n"))
    return rows.withColumn("share", S.pct(F.col("n"), F.sum("n").over(Window.partitionBy()), 4))


@plan("Q43_founder_profile", "SELECT s_nationkey, count(*) AS n, round(avg(s_acctbal), 4) AS mean, count(*) FILTER (WHERE s_acctbal > 5000) AS high FROM supplier GROUP BY 1 HAVING count(*) >= 2")
def q43(t: Tables) -> DataFrame:
    return t.supplier.groupBy("s_nationkey").agg(F.count("*").alias("n"), F.round(F.avg("s_acctbal"), 4).alias("mean"), F.count_if(F.col("s_acctbal") > 5000).alias("high")).filter("n >= 2")


@plan("Q48_taxonomy_hierarchy", "SELECT region, country, segment, count(*) AS n FROM companies GROUP BY GROUPING SETS ((region), (region, country), (region, country, segment))", "companies")
def q48(t: Tables) -> DataFrame:
    rows = t.companies.groupingSets([["region"], ["region", "country"], ["region", "country", "segment"]], "region", "country", "segment").agg(F.count("*").alias("n"))
    return rows.select("region", "country", "segment", "n")


@plan("K00_inventory", "SELECT verification_status, count(*) AS n, min(founded_year) AS first, max(founded_year) AS last, count(DISTINCT country) AS countries FROM companies GROUP BY 1", "companies")
def k00(t: Tables) -> DataFrame:
    return t.companies.groupBy("verification_status").agg(F.count("*").alias("n"), F.min("founded_year").alias("first"), F.max("founded_year").alias("last"), F.countDistinct("country").alias("countries"))


@plan("K05c_signal_availability", f"SELECT {BUCKET} AS bucket, round(100.0 * count(ai_score) / count(*), 4)::DOUBLE AS score, round(100.0 * count(llm_ai_verified) / count(*), 4)::DOUBLE AS verdict FROM companies GROUP BY 1", "companies")
def k05c(t: Tables) -> DataFrame:
    return t.companies.groupBy(P.coverage_bucket().alias("bucket")).agg(S.pct(F.count("ai_score"), F.count("*"), 4).alias("score"), S.pct(F.count("llm_ai_verified"), F.count("*"), 4).alias("verdict"))


@plan("K07_corrected_prevalence", """
SELECT lang, round(greatest(0, least(1, (p + spec - 1) / (sens + spec - 1))), 8) AS corrected FROM (SELECT lang, count(*) FILTER (WHERE length(text) >= 600)::DOUBLE / count(*) AS p FROM documents GROUP BY 1),
  (SELECT count(*) FILTER (WHERE y AND r)::DOUBLE / count(*) FILTER (WHERE r) AS sens, count(*) FILTER (WHERE NOT y AND NOT r)::DOUBLE / count(*) FILTER (WHERE NOT r) AS spec FROM (SELECT length(text) >= 600 AS y, quality = 1 AS r FROM documents JOIN labels USING (doc_id))) WHERE sens + spec > 1""")
def k07(t: Tables) -> DataFrame:
    y = F.length("text") >= 600
    share = t.documents.groupBy("lang").agg((F.count_if(y).cast("double") / F.count("*")).alias("p")).withColumn("one", F.lit(1))
    r = F.col("quality") == 1
    test = t.documents.join(t.labels, "doc_id").agg((F.count_if(y & r).cast("double") / F.count_if(r)).alias("sens"), (F.count_if(~y & ~r).cast("double") / F.count_if(~r)).alias("spec")).withColumn("one", F.lit(1))
    rows = share.join(F.broadcast(test), "one").filter("sens + spec > 1")
    return rows.select("lang", F.round(S.rogan_gladen(F.col("p"), F.col("sens"), F.col("spec")), 8).alias("corrected"))


@plan("K10_year_coverage", f"SELECT {BUCKET} AS bucket, count(*) AS n, count(founded_year) AS own, count({YEAR}) AS effective FROM companies GROUP BY 1", "companies")
def k10(t: Tables) -> DataFrame:
    return t.companies.groupBy(P.coverage_bucket().alias("bucket")).agg(F.count("*").alias("n"), F.count("founded_year").alias("own"), F.count(P.effective_year()).alias("effective"))


@plan("K14_constant_selection", f"SELECT y, ai, n, ai::DOUBLE / nullif(n, 0) AS share FROM (SELECT {YEAR} AS y, count(*) FILTER (WHERE {AI} AND {BUCKET} <> 'Unlisted') AS ai, count(*) FILTER (WHERE {BUCKET} <> 'Unlisted') AS n FROM companies GROUP BY 1)", "companies")
def k14(t: Tables) -> DataFrame:
    listed = P.coverage_bucket() != "Unlisted"
    rows = t.companies.groupBy(P.effective_year().alias("y")).agg(F.count_if(P.is_ai() & listed).alias("ai"), F.count_if(listed).alias("n"))
    return rows.withColumn("share", F.try_divide(F.col("ai").cast("double"), F.col("n").cast("double")))


@plan("K23_regions", shares_sql(f"region; {BAND} AS band", interval=True), "companies")
def k23(t: Tables) -> DataFrame:
    return shares(t.companies, "region", P.cohort_band(P.effective_year()).alias("band"), interval=True)


@plan("K28_missingness_by_channel", f"SELECT {_CHANNEL} AS channel, round(100.0 * (count(*) - count(domain)) / count(*), 4)::DOUBLE AS no_domain, round(100.0 * (count(*) - count(founded_year)) / count(*), 4)::DOUBLE AS no_year FROM {_FUNDED} GROUP BY 1", "companies", "deals")
def k28(t: Tables) -> DataFrame:
    missing = lambda c: S.pct(F.count("*") - F.count(c), F.count("*"), 4)
    return _funded(t).groupBy(P.channel(F.col("funded")).alias("channel")).agg(missing("domain").alias("no_domain"), missing("founded_year").alias("no_year"))


@plan("K29_missingness_outcome", f"SELECT has, count(*) AS n, round(100.0 * count(*) FILTER (WHERE operating_status = 'ipo') / count(*), 4)::DOUBLE AS ipo_pct FROM (SELECT domain IS NOT NULL AS has, operating_status FROM companies) GROUP BY 1", "companies")
def k29(t: Tables) -> DataFrame:
    return t.companies.groupBy(F.col("domain").isNotNull().alias("has")).agg(F.count("*").alias("n"), S.pct(F.count_if(F.col("operating_status") == "ipo"), F.count("*"), 4).alias("ipo_pct"))


@plan("K30_sector_early_late", f"SELECT tag, count(*) FILTER (WHERE {YEAR} <= 2012 AND {AI}) AS early, count(*) FILTER (WHERE {YEAR} > 2012 AND {AI}) AS late FROM firm_tags JOIN companies ON company_id = id GROUP BY 1", "companies", "firm_tags")
def k30(t: Tables) -> DataFrame:
    y, ai = P.effective_year(), P.is_ai()
    rows = t.firm_tags.join(t.companies, F.col("company_id") == F.col("id"))
    return rows.groupBy("tag").agg(F.count_if((y <= 2012) & ai).alias("early"), F.count_if((y > 2012) & ai).alias("late"))


@plan("K42_imputation_fill", f"SELECT {BUCKET} AS bucket, count(founded_year) AS before, count(coalesce(founded_year, cohort_year)) AS after FROM companies GROUP BY 1", "companies")
def k42(t: Tables) -> DataFrame:
    return t.companies.groupBy(P.coverage_bucket().alias("bucket")).agg(F.count("founded_year").alias("before"), F.count(F.coalesce("founded_year", "cohort_year")).alias("after"))


@plan("K44_imputation_accuracy", "SELECT count(*) AS n, count(*) FILTER (WHERE founded_year = cohort_year) AS exact, count(*) FILTER (WHERE abs(founded_year - cohort_year) <= 2) AS near FROM companies WHERE founded_year IS NOT NULL AND cohort_year IS NOT NULL", "companies")
def k44(t: Tables) -> DataFrame:
    both = t.companies.filter("founded_year IS NOT NULL AND cohort_year IS NOT NULL")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("founded_year") == F.col("cohort_year")).alias("exact"), F.count_if(F.abs(F.col("founded_year") - F.col("cohort_year")) <= 2).alias("near"))


@plan("K54_adjudication_sample", "SELECT id, domain FROM companies WHERE domain IN (SELECT domain FROM companies GROUP BY 1 HAVING count(*) > 1) ORDER BY md5(CAST(id AS VARCHAR)), id LIMIT 40", "companies")
def k54(t: Tables) -> DataFrame:
    c = t.companies
    shared = c.filter("domain IS NOT NULL").groupBy("domain").agg(F.count("*").alias("n")).filter("n > 1").select("domain")
    return c.join(shared, "domain", "left_semi").select("id", "domain").orderBy(F.md5(F.col("id").cast("string")), "id").limit(40)


_LO, _HI = wilson_sql("k", "n")


@plan("K63_reference_rate", f"SELECT source, n, k, round(100 * {_LO}, 6) AS lo, round(100 * {_HI}, 6) AS hi FROM (SELECT source, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS k FROM documents JOIN labels USING (doc_id) GROUP BY 1)")
def k63(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("k"))
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    return rows.select("source", "n", "k", F.round(100 * lo, 6).alias("lo"), F.round(100 * hi, 6).alias("hi"))


@plan("D02_site_health_table", "SELECT site, count(*) AS runs, count(*) FILTER (WHERE status = 'success') AS good, max(finished_at) AS last FROM runs GROUP BY 1", "runs")
def d02(t: Tables) -> DataFrame:
    return t.runs.groupBy("site").agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "success").alias("good"), F.max("finished_at").alias("last"))


@plan("D03_recent_runs", "SELECT event_id, site, status FROM runs WHERE finished_at >= (SELECT max(finished_at) FROM runs) - INTERVAL 24 HOUR", "runs")
def d03(t: Tables) -> DataFrame:
    r = t.runs
    last = r.agg(F.max("finished_at").alias("m")).withColumn("one", F.lit(1))
    return r.withColumn("one", F.lit(1)).join(F.broadcast(last), "one").filter(F.col("finished_at") >= F.col("m") - F.expr("INTERVAL 24 HOURS")).select("event_id", "site", "status")


@plan("D05_adoption_curve", shares_sql(f"{YEAR} AS y", where=f"{YEAR} BETWEEN 2005 AND 2024"), "companies")
def d05(t: Tables) -> DataFrame:
    return shares(t.companies.filter(P.effective_year().between(2005, 2024)), P.effective_year().alias("y"))


@plan("D16_site_country", "SELECT page_id, coalesce(CASE WHEN url LIKE '%/fr/%' THEN 'France' WHEN url LIKE '%/de/%' THEN 'Germany' END, CASE WHEN html LIKE '%lang=\"es\"%' THEN 'Spain' END, 'Unknown') AS country FROM pages")
def d16(t: Tables) -> DataFrame:
    url = F.col("url")
    by_url = F.when(url.contains("/fr/"), "France").when(url.contains("/de/"), "Germany")
    return t.pages.select("page_id", F.coalesce(by_url, F.when(F.col("html").contains('lang="es"'), "Spain"), F.lit("Unknown")).alias("country"))


@plan("D18_bucket_stats", shares_sql(f"{BUCKET} AS bucket; operating_status"), "companies")
def d18(t: Tables) -> DataFrame:
    return shares(t.companies, P.coverage_bucket().alias("bucket"), "operating_status")


@plan("D20_hidden_search", f"SELECT id, name FROM companies WHERE {HIDDEN} AND (name ILIKE '%00000%' OR domain ILIKE '%firm1%') AND {AI} ORDER BY ai_score DESC NULLS LAST, id LIMIT 5000", "companies")
def d20(t: Tables) -> DataFrame:
    found = hidden(t).filter((F.col("name").ilike("%00000%") | F.col("domain").ilike("%firm1%")) & P.is_ai())
    return found.orderBy(F.desc_nulls_last("ai_score"), "id").limit(5000).select("id", "name")


@plan("D22_value_counts", "SELECT segment AS value, count(*) AS n FROM companies WHERE segment IS NOT NULL GROUP BY 1", "companies")
def d22(t: Tables) -> DataFrame:
    return t.companies.filter("segment IS NOT NULL").groupBy(F.col("segment").alias("value")).agg(F.count("*").alias("n"))


@plan("D25_new_this_week", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'signup') AS signups FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1")
def d25(t: Tables) -> DataFrame:
    e = t.events
    last = e.agg(F.max("ts").alias("m")).withColumn("one", F.lit(1))
    rows = e.withColumn("one", F.lit(1)).join(F.broadcast(last), "one").filter(F.col("ts") >= F.col("m") - F.expr("INTERVAL 7 DAYS"))
    return rows.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "signup").alias("signups"))


@plan("D34_operations", "SELECT difficulty, status, count(*) AS n, round(avg(seconds), 4) AS mean_seconds, count(DISTINCT site) AS sites FROM runs GROUP BY 1, 2", "runs")
def d34(t: Tables) -> DataFrame:
    return t.runs.groupBy("difficulty", "status").agg(F.count("*").alias("n"), F.round(F.avg("seconds"), 4).alias("mean_seconds"), F.countDistinct("site").alias("sites"))


@plan("D37_taxonomy_overview", f"SELECT segment, count(*) AS n, count(DISTINCT country) AS countries, round(100.0 * count(*) FILTER (WHERE {AI}) / count(*), 0)::DOUBLE AS ai_pct, max(ai_score) AS best FROM companies GROUP BY 1", "companies")
def d37(t: Tables) -> DataFrame:
    return t.companies.groupBy("segment").agg(F.count("*").alias("n"), F.countDistinct("country").alias("countries"), S.pct(F.count_if(P.is_ai()), F.count("*"), 0).alias("ai_pct"), F.max("ai_score").alias("best"))


@plan("D43_geographic_momentum", f"SELECT region, recent, prior, round(100.0 * recent / nullif(prior, 0) - 100, 6)::DOUBLE AS momentum FROM (SELECT region, count(*) FILTER (WHERE {YEAR} >= 2015) AS recent, count(*) FILTER (WHERE {YEAR} < 2015) AS prior FROM companies GROUP BY 1)", "companies")
def d43(t: Tables) -> DataFrame:
    y = P.effective_year()
    rows = t.companies.groupBy("region").agg(F.count_if(y >= 2015).alias("recent"), F.count_if(y < 2015).alias("prior"))
    return rows.withColumn("momentum", F.round(F.try_divide(100 * F.col("recent").cast("double"), F.col("prior").cast("double")) - 100, 6))


@plan("D44_totals", "SELECT region, country, count(*) AS n FROM companies GROUP BY GROUPING SETS ((region), (country))", "companies")
def d44(t: Tables) -> DataFrame:
    return t.companies.groupingSets([["region"], ["country"]], "region", "country").agg(F.count("*").alias("n")).select("region", "country", "n")


@plan("D46_channel_facts", f"SELECT {_CHANNEL} AS channel, count(*) AS n, count(DISTINCT domain) AS domains, count(DISTINCT country) AS countries FROM {_FUNDED} WHERE {HIDDEN} GROUP BY 1 HAVING count(*) >= 10", "companies", "deals")
def d46(t: Tables) -> DataFrame:
    rows = _funded(t).filter(P.coverage_bucket() == "Unlisted").groupBy(P.channel(F.col("funded")).alias("channel"))
    return rows.agg(F.count("*").alias("n"), F.countDistinct("domain").alias("domains"), F.countDistinct("country").alias("countries")).filter("n >= 10")


@plan("D48_recent_hidden", f"SELECT id, name FROM companies WHERE {HIDDEN} AND NOT name ILIKE '%7' ORDER BY coalesce({YEAR}, 0) DESC, id LIMIT 30", "companies")
def d48(t: Tables) -> DataFrame:
    return hidden(t).filter(~F.col("name").ilike("%7")).orderBy(F.coalesce(P.effective_year(), F.lit(0)).desc(), "id").limit(30).select("id", "name")


@plan("D50_vocabulary", "SELECT tag, count(*) AS n FROM firm_tags GROUP BY 1 HAVING count(*) >= 20", "firm_tags")
def d50(t: Tables) -> DataFrame:
    return t.firm_tags.groupBy("tag").agg(F.count("*").alias("n")).filter("n >= 20")


@plan("D51_scope_series", f"SELECT {YEAR} AS y, count(*) AS n, count(*) FILTER (WHERE {AI}) AS ai FROM companies WHERE region = 'ASIA' AND id IN (SELECT company_id FROM firm_tags WHERE tag = 'PROMO') GROUP BY 1", "companies", "firm_tags")
def d51(t: Tables) -> DataFrame:
    tagged = t.firm_tags.filter("tag = 'PROMO'").select(F.col("company_id").alias("id"))
    return t.companies.filter("region = 'ASIA'").join(tagged, "id", "left_semi").groupBy(P.effective_year().alias("y")).agg(F.count("*").alias("n"), F.count_if(P.is_ai()).alias("ai"))


@plan("D54_peak_share", "SELECT arg_max(deal_year, (share, deal_year)) AS peak_year FROM (SELECT deal_year, count(*) FILTER (WHERE status = 'F')::DOUBLE / count(*) AS share FROM deals GROUP BY 1 HAVING count(*) >= 100)", "deals")
def d54(t: Tables) -> DataFrame:
    rows = t.deals.groupBy("deal_year").agg((F.count_if(F.col("status") == "F").cast("double") / F.count("*")).alias("share"), F.count("*").alias("n")).filter("n >= 100")
    return rows.agg(F.max_by("deal_year", F.struct("share", "deal_year")).alias("peak_year"))


@plan("D55_work_queue", "SELECT id FROM companies WHERE (founded_year IS NULL OR total_raised IS NULL) AND id NOT IN (SELECT company_id FROM deals WHERE deal_size > 490000) ORDER BY (domain IS NULL), id LIMIT 100", "companies", "deals")
def d55(t: Tables) -> DataFrame:
    tried = t.deals.filter("deal_size > 490000").select(F.col("company_id").alias("id"))
    rows = t.companies.filter("founded_year IS NULL OR total_raised IS NULL").join(tried, "id", "left_anti")
    return rows.orderBy(F.col("domain").isNull(), "id").limit(100).select("id")


@plan("D56_candidate_funnel", "SELECT s_suppkey FROM supplier WHERE 'firm' || s_suppkey || '.example.com' NOT IN (SELECT domain FROM companies WHERE domain IS NOT NULL) AND s_acctbal >= CASE WHEN s_nationkey < 7 THEN 4000 ELSE 5000 END", "companies")
def d56(t: Tables) -> DataFrame:
    domain = F.concat(F.lit("firm"), F.col("s_suppkey").cast("string"), F.lit(".example.com"))
    fresh = t.supplier.withColumn("domain", domain).join(t.companies.filter("domain IS NOT NULL").select("domain"), "domain", "left_anti")
    return fresh.filter(F.col("s_acctbal") >= F.when(F.col("s_nationkey") < 7, 4000).otherwise(5000)).select("s_suppkey")


@plan("G02_country_top_segments", "SELECT country, segment, round(m, 6) AS mean_score FROM (SELECT country, segment, avg(ai_score) AS m, row_number() OVER (PARTITION BY country ORDER BY round(avg(ai_score), 9) DESC NULLS LAST, segment) AS k FROM companies GROUP BY 1, 2) WHERE k <= 2", "companies")
def g02(t: Tables) -> DataFrame:
    rows = t.companies.groupBy("country", "segment").agg(F.avg("ai_score").alias("m"))
    return top_per_key(rows, ["country"], [F.round("m", 9).desc_nulls_last(), F.col("segment")], 2).select("country", "segment", F.round("m", 6).alias("mean_score"))
