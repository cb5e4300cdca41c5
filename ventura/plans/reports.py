"""Named reports: research tables, coverage analyses, dashboards and service endpoints over the firm model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ventura.functions import predicates as P
from ventura.functions import stats as S
from ventura.operators.joins import top_per_key
from ventura.plans.aggregates import AI, BUCKET, YEAR
from ventura.plans.catalogue import plan
from ventura.plans.model import Tables
from ventura.plans.statistics import wilson_sql

BAND = f"CASE WHEN {YEAR} <= 2009 THEN '<=2009' WHEN {YEAR} <= 2014 THEN '2010-14' WHEN {YEAR} <= 2019 THEN '2015-19' WHEN {YEAR} <= 2100 THEN '2020+' END"
_LO, _HI = wilson_sql("ai", "n")


def shares(df: DataFrame, *keys: Column | str, least: int = 0, interval: bool = False) -> DataFrame:
    """n, ai and ai_pct per key, cells under ``least`` rows left out; with ``interval`` the Wilson interval."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(P.is_ai()).alias("ai")).filter(F.col("n") >= least)
    out = out.withColumn("ai_pct", S.pct(F.col("ai"), F.col("n"), 4))
    if interval:
        lo, hi = S.wilson(F.col("ai"), F.col("n"))
        out = out.withColumn("lo", F.round(100 * lo, 6)).withColumn("hi", F.round(100 * hi, 6))
    return out


def shares_sql(keys: str, source: str = "companies", least: int = 0, interval: bool = False, where: str = "true") -> str:
    names = [k.rsplit(" AS ", 1)[-1] for k in keys.split("; ")]
    more = f", round(100 * {_LO}, 6) AS lo, round(100 * {_HI}, 6) AS hi" if interval else ""
    return f"SELECT {', '.join(names)}, n, ai, round(100.0 * ai / n, 4)::DOUBLE AS ai_pct{more} FROM (SELECT {keys.replace('; ', ', ')}, count(*) AS n, count(*) FILTER (WHERE {AI}) AS ai FROM {source} WHERE {where} GROUP BY ALL HAVING count(*) >= {least})"


def _funded(t: Tables) -> DataFrame:
    """Companies with a flag of a large deal."""
    big = t.deals.filter("deal_size > 450000").select("company_id").distinct()
    return t.companies.join(big, F.col("company_id") == F.col("id"), "left").withColumn("funded", F.col("company_id").isNotNull())


_FUNDED = "(SELECT c.*, s.company_id IS NOT NULL AS funded FROM companies c LEFT JOIN (SELECT DISTINCT company_id FROM deals WHERE deal_size > 450000) s ON s.company_id = c.id)"
_CHANNEL = "CASE WHEN funded THEN 'financing' WHEN naics_code IS NOT NULL THEN 'grants' WHEN incubator_source = 'accelerator' THEN 'accelerator' ELSE 'other' END"
_DEALS = "deals JOIN companies ON company_id = id"


def _deals(t: Tables) -> DataFrame:
    return t.deals.join(t.companies, F.col("company_id") == F.col("id"))


@plan("Q01_formation_timeline", shares_sql(f"{YEAR} AS y", where=f"{YEAR} IS NOT NULL"), "companies")
def q01(t: Tables) -> DataFrame:
    return shares(t.companies.filter(P.effective_year().isNotNull()), P.effective_year().alias("y"))


@plan("Q02_geographic_concentration", f"SELECT country, n, ai, round(100.0 * ai / n, 4)::DOUBLE AS ai_pct, round(100.0 * ai / sum(ai) OVER (), 4)::DOUBLE AS share FROM (SELECT country, count(*) AS n, count(*) FILTER (WHERE {AI}) AS ai FROM companies GROUP BY 1 HAVING count(*) >= 3)", "companies")
def q02(t: Tables) -> DataFrame:
    return shares(t.companies, "country", least=3).withColumn("share", S.pct(F.col("ai"), F.sum("ai").over(Window.partitionBy()), 4))


@plan("Q03_country_year_matrix", f"SELECT country, {YEAR} AS y, count(*) FILTER (WHERE {AI}) AS ai FROM companies WHERE country IN (SELECT country FROM companies GROUP BY 1 ORDER BY count(*) FILTER (WHERE {AI}) DESC, country LIMIT 8) GROUP BY 1, 2", "companies")
def q03(t: Tables) -> DataFrame:
    c = t.companies
    top = c.groupBy("country").agg(F.count_if(P.is_ai()).alias("k")).orderBy(F.desc("k"), "country").limit(8).select("country")
    return c.join(F.broadcast(top), "country", "left_semi").groupBy("country", P.effective_year().alias("y")).agg(F.count_if(P.is_ai()).alias("ai"))


@plan("Q04_verticals", shares_sql("tag", "firm_tags JOIN companies ON company_id = id", 30), "companies", "firm_tags")
def q04(t: Tables) -> DataFrame:
    return shares(t.firm_tags.join(t.companies, F.col("company_id") == F.col("id")), "tag", least=30)


@plan("Q05a_funding_by_year", f"SELECT deal_year, count(*) AS deals, count(*) FILTER (WHERE {AI}) AS ai_deals, round(sum(deal_size), 2) AS total, quantile_cont(deal_size, 0.5) FILTER (WHERE {AI}) AS ai_median FROM {_DEALS} GROUP BY 1", "companies", "deals")
def q05a(t: Tables) -> DataFrame:
    ai = P.is_ai()
    return _deals(t).groupBy("deal_year").agg(F.count("*").alias("deals"), F.count_if(ai).alias("ai_deals"), F.round(F.sum("deal_size"), 2).alias("total"), F.percentile(F.when(ai, F.col("deal_size")), 0.5).alias("ai_median"))


@plan("Q05b_funding_by_round", shares_sql("round_type", _DEALS), "companies", "deals")
def q05b(t: Tables) -> DataFrame:
    return shares(_deals(t), "round_type")


@plan("Q05c_total_raised", f"SELECT coalesce({AI}, false) AS is_ai, count(total_raised) AS n, quantile_cont(total_raised, 0.5) AS median_usd, round(avg(total_raised), 2) AS mean_usd FROM companies GROUP BY 1", "companies")
def q05c(t: Tables) -> DataFrame:
    return t.companies.groupBy(F.coalesce(P.is_ai(), F.lit(False)).alias("is_ai")).agg(F.count("total_raised").alias("n"), F.percentile("total_raised", 0.5).alias("median_usd"), F.round(F.avg("total_raised"), 2).alias("mean_usd"))


@plan("Q06_home_vs_abroad", shares_sql(f"region = 'AMERICA' AS home; {BAND} AS band"), "companies")
def q06(t: Tables) -> DataFrame:
    return shares(t.companies, (F.col("region") == "AMERICA").alias("home"), P.cohort_band(P.effective_year()).alias("band"))


@plan("Q07_data_lag", f"SELECT y, n, round(greatest(0, 1 - n::DOUBLE / max(n) OVER ()), 6) AS missing FROM (SELECT {YEAR} AS y, count(*) AS n FROM companies GROUP BY 1)", "companies")
def q07(t: Tables) -> DataFrame:
    rows = t.companies.groupBy(P.effective_year().alias("y")).agg(F.count("*").alias("n"))
    return rows.withColumn("missing", F.round(F.greatest(F.lit(0.0), 1 - F.col("n").cast("double") / F.max("n").over(Window.partitionBy())), 6))


@plan("Q08_ai_export", f"SELECT id, name, country, domain, ai_score, {YEAR} AS y FROM companies WHERE {AI}", "companies")
def q08(t: Tables) -> DataFrame:
    return t.companies.filter(P.is_ai()).select("id", "name", "country", "domain", "ai_score", P.effective_year().alias("y"))


@plan("Q09_hidden_formation", shares_sql(f"{YEAR} AS y", where="verification_status = 'emerging_github'"), "companies")
def q09(t: Tables) -> DataFrame:
    return shares(t.companies.filter("verification_status = 'emerging_github'"), P.effective_year().alias("y"))


@plan("Q09b_hidden_survival", f"SELECT {BAND} AS band, count(*) AS n, round(100.0 * count(*) FILTER (WHERE operating_status <> 'closed') / count(*), 4)::DOUBLE AS alive FROM companies WHERE verification_status = 'emerging_github' GROUP BY 1", "companies")
def q09b(t: Tables) -> DataFrame:
    hidden = t.companies.filter("verification_status = 'emerging_github'")
    return hidden.groupBy(P.cohort_band(P.effective_year()).alias("band")).agg(F.count("*").alias("n"), S.pct(F.count_if(F.col("operating_status") != "closed"), F.count("*"), 4).alias("alive"))


for _number, _name, _sql, _column in (
    ("Q10", "founding_year", YEAR, P.effective_year),
    ("Q11", "region", "region", lambda: F.col("region")),
    ("Q12", "segment", "segment", lambda: F.col("segment")),
    ("Q13", "ai_adoption", AI, P.is_ai),
):

    @plan(f"{_number}_hidden_vs_listed_{_name}", f"SELECT {BUCKET} AS bucket, {_sql} AS value, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY {BUCKET}), 4)::DOUBLE AS share FROM companies GROUP BY 1, 2", "companies")
    def _compared(t: Tables, column=_column) -> DataFrame:
        rows = t.companies.groupBy(P.coverage_bucket().alias("bucket"), column().alias("value")).agg(F.count("*").alias("n"))
        return rows.withColumn("share", S.pct(F.col("n"), F.sum("n").over(Window.partitionBy("bucket")), 4))


@plan("Q23_exit_outcomes", f"SELECT {AI} AS is_ai, count(*) AS n, round(100.0 * count(*) FILTER (WHERE operating_status IN ('acquired', 'ipo')) / count(*), 1)::DOUBLE AS exit_pct FROM companies GROUP BY 1", "companies")
def q23(t: Tables) -> DataFrame:
    return t.companies.groupBy(P.is_ai().alias("is_ai")).agg(F.count("*").alias("n"), S.pct(F.count_if(F.col("operating_status").isin("acquired", "ipo")), F.count("*")).alias("exit_pct"))


@plan("Q30_graduation_by_ai", f"SELECT is_ai, count(*) AS firms, round(100.0 * count(*) FILTER (WHERE top >= 3) / count(*), 4)::DOUBLE AS reached FROM (SELECT company_id, max(round_rank) AS top, bool_or(coalesce({AI}, false)) AS is_ai FROM {_DEALS} GROUP BY 1) GROUP BY 1", "companies", "deals")
def q30(t: Tables) -> DataFrame:
    firm = _deals(t).groupBy("company_id").agg(F.max("round_rank").alias("top"), F.bool_or(F.coalesce(P.is_ai(), F.lit(False))).alias("is_ai"))
    return firm.groupBy("is_ai").agg(F.count("*").alias("firms"), S.pct(F.count_if(F.col("top") >= 3), F.count("*"), 4).alias("reached"))


@plan("Q31_round_timing", "SELECT round_rank, round(median(months), 6) AS median_months FROM (SELECT round_rank, date_diff('day', lag(deal_date) OVER (PARTITION BY company_id ORDER BY deal_date, deal_id), deal_date) / 30.44 AS months FROM deals) GROUP BY 1", "deals")
def q31(t: Tables) -> DataFrame:
    w = Window.partitionBy("company_id").orderBy("deal_date", "deal_id")
    rows = t.deals.select("round_rank", (F.datediff("deal_date", F.lag("deal_date").over(w)) / F.lit(30.44)).alias("months"))
    return rows.groupBy("round_rank").agg(F.round(F.percentile("months", 0.5), 6).alias("median_months"))


@plan("Q32_investor_specialisation", f"""
SELECT CASE WHEN s >= 0.6 THEN 'specialist' WHEN s >= 0.4 THEN 'mixed' ELSE 'generalist' END AS band, count(*) AS investors FROM (SELECT investor_id, count(*) FILTER (WHERE {AI})::DOUBLE / count(*) AS s FROM edges JOIN deals ON round_id = deal_id JOIN companies ON company_id = id GROUP BY 1 HAVING count(*) >= 5) GROUP BY 1""", "companies", "deals", "edges")
def q32(t: Tables) -> DataFrame:
    rows = t.edges.join(_deals(t), F.col("round_id") == F.col("deal_id")).groupBy("investor_id").agg(F.count("*").alias("n"), (F.count_if(P.is_ai()).cast("double") / F.count("*")).alias("s")).filter("n >= 5")
    return rows.groupBy(F.when(F.col("s") >= 0.6, "specialist").when(F.col("s") >= 0.4, "mixed").otherwise("generalist").alias("band")).agg(F.count("*").alias("investors"))


@plan("Q33_syndication", "SELECT deal_year, round(avg(k), 6) AS mean_investors, max(k) AS most FROM (SELECT round_id, count(*) AS k FROM edges GROUP BY 1) JOIN deals ON round_id = deal_id GROUP BY 1", "edges", "deals")
def q33(t: Tables) -> DataFrame:
    sizes = t.edges.groupBy("round_id").agg(F.count("*").alias("k"))
    return sizes.join(t.deals, F.col("round_id") == F.col("deal_id")).groupBy("deal_year").agg(F.round(F.avg("k"), 6).alias("mean_investors"), F.max("k").alias("most"))


@plan("Q34_identity_timing", f"SELECT CASE WHEN NOT cb_ai_tagged AND {AI} THEN 'became' WHEN cb_ai_tagged AND {AI} THEN 'always' WHEN NOT {AI} THEN 'never' ELSE 'unknown' END AS identity, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM companies GROUP BY 1", "companies")
def q34(t: Tables) -> DataFrame:
    tag, ai = F.col("cb_ai_tagged"), P.is_ai()
    kind = F.when(~tag & ai, "became").when(tag & ai, "always").when(~ai, "never").otherwise("unknown")
    return t.companies.groupBy(kind.alias("identity")).agg(F.count("*").alias("n")).withColumn("share", F.col("n").cast("double") / F.sum("n").over(Window.partitionBy()))


@plan("Q35_origins_of_repackagers", f"SELECT tag, count(*) AS n FROM firm_tags JOIN companies ON company_id = id WHERE NOT cb_ai_tagged AND {AI} GROUP BY 1", "companies", "firm_tags")
def q35(t: Tables) -> DataFrame:
    return t.firm_tags.join(t.companies.filter(~F.col("cb_ai_tagged") & P.is_ai()), F.col("company_id") == F.col("id")).groupBy("tag").agg(F.count("*").alias("n"))


@plan("Q41_adoption_timing", f"SELECT {BAND} AS band, cb_ai_tagged AS then, ai_mentioned AS now, count(*) AS n FROM companies GROUP BY 1, 2, 3", "companies")
def q41(t: Tables) -> DataFrame:
    return t.companies.groupBy(P.cohort_band(P.effective_year()).alias("band"), F.col("cb_ai_tagged").alias("then"), F.col("ai_mentioned").alias("now")).agg(F.count("*").alias("n"))


@plan("K01_share_by_bucket", shares_sql(f"{BUCKET} AS bucket", interval=True), "companies")
def k01(t: Tables) -> DataFrame:
    return shares(t.companies, P.coverage_bucket().alias("bucket"), interval=True)


@plan("K03_strict_buckets", shares_sql("CASE WHEN verification_status = 'verified_cb_pb' THEN 'both' WHEN verification_status = 'verified_cb' THEN 'cb_only' WHEN verification_status = 'verified_pb' THEN 'pb_only' ELSE 'hidden' END AS bucket"), "companies")
def k03(t: Tables) -> DataFrame:
    return shares(t.companies, P.strict_bucket().alias("bucket"))


@plan("K04_unlisted_by_channel", shares_sql(f"{_CHANNEL} AS channel", _FUNDED, where=f"{BUCKET} = 'Unlisted'"), "companies", "deals")
def k04(t: Tables) -> DataFrame:
    return shares(_funded(t).filter(P.coverage_bucket() == "Unlisted"), P.channel(F.col("funded")).alias("channel"))


@plan("K05_leave_one_channel_out", f"SELECT channel, sum(n) OVER () - n AS n, sum(ai) OVER () - ai AS ai FROM (SELECT {_CHANNEL} AS channel, count(*) AS n, count(*) FILTER (WHERE {AI}) AS ai FROM {_FUNDED} WHERE {BUCKET} = 'Unlisted' GROUP BY 1)", "companies", "deals")
def k05(t: Tables) -> DataFrame:
    rows = k04(t)
    every = Window.partitionBy()
    return rows.select("channel", (F.sum("n").over(every) - F.col("n")).alias("n"), (F.sum("ai").over(every) - F.col("ai")).alias("ai"))


@plan("K06_coverage_by_bucket", f"SELECT {BUCKET} AS bucket, 100.0 * count(domain) / count(*) AS domain, 100.0 * count(founded_year) / count(*) AS founded_year, 100.0 * count(total_raised) / count(*) AS total_raised FROM companies GROUP BY 1", "companies")
def k06(t: Tables) -> DataFrame:
    filled = lambda c: (100 * F.count(c).cast("double") / F.count("*")).alias(c)
    return t.companies.groupBy(P.coverage_bucket().alias("bucket")).agg(filled("domain"), filled("founded_year"), filled("total_raised"))


@plan("K11_formation_by_year", shares_sql(f"{YEAR} AS y", interval=True, least=5), "companies")
def k11(t: Tables) -> DataFrame:
    return shares(t.companies, P.effective_year().alias("y"), least=5, interval=True)


@plan("K12_by_year_and_database", f"SELECT {YEAR} AS y, " + ", ".join(f"count(*) FILTER (WHERE {AI} AND {BUCKET} = '{b}') AS {b.lower()}" for b in ("A", "B", "Unlisted")) + " FROM companies GROUP BY 1", "companies")
def k12(t: Tables) -> DataFrame:
    rows = t.companies.select(P.effective_year().alias("y"), P.coverage_bucket().alias("bucket"), P.is_ai().alias("ai"))
    return rows.groupBy("y").pivot("bucket", ["A", "B", "Unlisted"]).agg(F.count_if("ai")).na.fill(0, ["A", "B", "Unlisted"]).toDF("y", "a", "b", "unlisted")


@plan("K13_entry_lag", "SELECT founded_year, round(avg(deal_year - founded_year), 6) AS mean_lag, count(*) AS n FROM companies JOIN (SELECT company_id, min(deal_year) AS deal_year FROM deals GROUP BY 1) ON company_id = id WHERE founded_year IS NOT NULL GROUP BY 1", "companies", "deals")
def k13(t: Tables) -> DataFrame:
    first = t.deals.groupBy("company_id").agg(F.min("deal_year").alias("deal_year"))
    rows = t.companies.filter("founded_year IS NOT NULL").join(first, F.col("company_id") == F.col("id"))
    return rows.groupBy("founded_year").agg(F.round(F.avg(F.col("deal_year") - F.col("founded_year")), 6).alias("mean_lag"), F.count("*").alias("n"))


@plan("K20_country_ai", shares_sql("country", least=40, interval=True), "companies")
def k20(t: Tables) -> DataFrame:
    return shares(t.companies, "country", least=40, interval=True)


@plan("K24_novelty_by_channel", shares_sql(f"{_CHANNEL} AS channel; {BUCKET} = 'Unlisted' AS novel", _FUNDED, interval=True), "companies", "deals")
def k24(t: Tables) -> DataFrame:
    return shares(_funded(t), P.channel(F.col("funded")).alias("channel"), (P.coverage_bucket() == "Unlisted").alias("novel"), interval=True)


@plan("K25_novelty_by_source", "SELECT coalesce(incubator_source, '(no source)') AS source, count(*) AS n, count(DISTINCT domain) AS domains FROM companies GROUP BY 1 HAVING count(*) >= 30", "companies")
def k25(t: Tables) -> DataFrame:
    return t.companies.groupBy(F.coalesce("incubator_source", F.lit("(no source)")).alias("source")).agg(F.count("*").alias("n"), F.countDistinct("domain").alias("domains")).filter("n >= 30")


@plan("K31_sector_by_year", shares_sql(f"tag; {YEAR} AS y", "firm_tags JOIN companies ON company_id = id"), "companies", "firm_tags")
def k31(t: Tables) -> DataFrame:
    return shares(t.firm_tags.join(t.companies, F.col("company_id") == F.col("id")), "tag", P.effective_year().alias("y"))


@plan("D01_newest_firms", f"SELECT id, d.deal_id, coalesce({AI} OR ai_score >= 0.3, false) AS is_ai FROM companies LEFT JOIN (SELECT * FROM deals QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY deal_date DESC, deal_id) = 1) d ON d.company_id = id ORDER BY d.deal_date DESC NULLS LAST, id LIMIT 15000", "companies", "deals")
def d01(t: Tables) -> DataFrame:
    latest = top_per_key(t.deals, ["company_id"], [F.desc("deal_date"), F.col("deal_id")]).select("company_id", "deal_id", "deal_date")
    rows = t.companies.join(latest, F.col("company_id") == F.col("id"), "left").orderBy(F.desc_nulls_last("deal_date"), "id").limit(15000)
    return rows.select("id", "deal_id", F.coalesce(P.is_ai() | (F.col("ai_score") >= 0.3), F.lit(False)).alias("is_ai"))


@plan("D04_overview", f"SELECT count(*) AS firms, count(*) FILTER (WHERE {AI}) AS ai, count(DISTINCT country) AS countries, count(total_raised) AS raised FROM companies", "companies")
def d04(t: Tables) -> DataFrame:
    return t.companies.agg(F.count("*").alias("firms"), F.count_if(P.is_ai()).alias("ai"), F.countDistinct("country").alias("countries"), F.count("total_raised").alias("raised"))


@plan("D06_country_stats", shares_sql("country", least=50), "companies")
def d06(t: Tables) -> DataFrame:
    return shares(t.companies, "country", least=50)


@plan("D07_source_stats", shares_sql("coalesce(incubator_source, '(no source)') AS source"), "companies")
def d07(t: Tables) -> DataFrame:
    return shares(t.companies, F.coalesce("incubator_source", F.lit("(no source)")).alias("source"))


@plan("D10_filter_options", "SELECT operating_status, count(*) AS n FROM companies GROUP BY 1", "companies")
def d10(t: Tables) -> DataFrame:
    return t.companies.groupBy("operating_status").agg(F.count("*").alias("n"))


@plan("D13_stage_volume", "SELECT CASE WHEN left(round_type, 1) IN ('1', '2') THEN 'early' WHEN left(round_type, 1) = '3' THEN 'mid' ELSE 'late' END AS stage, deal_year, count(*) AS n FROM deals GROUP BY 1, 2", "deals")
def d13(t: Tables) -> DataFrame:
    return t.deals.groupBy(P.stage_bucket(F.col("round_type")).alias("stage"), "deal_year").agg(F.count("*").alias("n"))


@plan("D14_median_trend", "SELECT deal_year, round_type, quantile_cont(deal_size, 0.5) AS median_size FROM deals GROUP BY 1, 2 HAVING count(*) >= 5", "deals")
def d14(t: Tables) -> DataFrame:
    return t.deals.groupBy("deal_year", "round_type").agg(F.percentile("deal_size", 0.5).alias("median_size"), F.count("*").alias("n")).filter("n >= 5").drop("n")


@plan("D15_first_financing", f"SELECT y, is_ai, count(*) AS firms FROM (SELECT company_id, min(deal_year) AS y, bool_or(coalesce({AI}, false)) AS is_ai FROM {_DEALS} GROUP BY 1) GROUP BY 1, 2", "companies", "deals")
def d15(t: Tables) -> DataFrame:
    firm = _deals(t).groupBy("company_id").agg(F.min("deal_year").alias("y"), F.bool_or(F.coalesce(P.is_ai(), F.lit(False))).alias("is_ai"))
    return firm.groupBy("y", "is_ai").agg(F.count("*").alias("firms"))


@plan("D33_contribution", f"SELECT {BUCKET} AS bucket, funded, count(*) AS n, count(DISTINCT domain) AS domains FROM {_FUNDED} GROUP BY 1, 2", "companies", "deals")
def d33(t: Tables) -> DataFrame:
    return _funded(t).groupBy(P.coverage_bucket().alias("bucket"), "funded").agg(F.count("*").alias("n"), F.countDistinct("domain").alias("domains"))


@plan("D39_metric_trends", "SELECT m, n, sum(n) OVER (ORDER BY m) AS total, sum(new) OVER (ORDER BY m) AS countries FROM (SELECT m, count(*) AS n, count(*) FILTER (WHERE k = 1) AS new FROM (SELECT strftime(deal_date, '%Y-%m') AS m, row_number() OVER (PARTITION BY company_id % 25 ORDER BY deal_date, deal_id) AS k FROM deals) GROUP BY 1)", "deals")
def d39(t: Tables) -> DataFrame:
    rows = t.deals.select("deal_date", "deal_id", (F.col("company_id") % 25).alias("c"))
    first = rows.groupBy("c").agg(F.min(F.date_format("deal_date", "yyyy-MM")).alias("m")).groupBy("m").agg(F.count("*").alias("new"))
    months = rows.groupBy(F.date_format("deal_date", "yyyy-MM").alias("m")).agg(F.count("*").alias("n")).join(first, "m", "left")
    running = Window.orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    return months.select("m", "n", F.sum("n").over(running).alias("total"), F.sum(F.coalesce("new", F.lit(0))).over(running).alias("countries"))


@plan("D42_category_momentum", f"""
SELECT tag, recent, prior, round(100.0 * (recent::DOUBLE / r_all) / (prior::DOUBLE / p_all) - 100, 6) AS momentum FROM (SELECT tag, count(*) FILTER (WHERE {YEAR} >= 2015) AS recent, count(*) FILTER (WHERE {YEAR} < 2015) AS prior FROM firm_tags JOIN companies ON company_id = id GROUP BY 1),
  (SELECT count(*) FILTER (WHERE {YEAR} >= 2015) AS r_all, count(*) FILTER (WHERE {YEAR} < 2015) AS p_all FROM companies) WHERE recent >= 50 AND prior >= 15""", "companies", "firm_tags")
def d42(t: Tables) -> DataFrame:
    y = P.effective_year()
    whole = t.companies.agg(F.count_if(y >= 2015).alias("r_all"), F.count_if(y < 2015).alias("p_all")).withColumn("one", F.lit(1))
    rows = t.firm_tags.join(t.companies, F.col("company_id") == F.col("id")).groupBy("tag").agg(F.count_if(y >= 2015).alias("recent"), F.count_if(y < 2015).alias("prior")).filter("recent >= 50 AND prior >= 15")
    rows = rows.withColumn("one", F.lit(1)).join(F.broadcast(whole), "one")
    return rows.select("tag", "recent", "prior", F.round(100 * (F.col("recent") / F.col("r_all")) / (F.col("prior") / F.col("p_all")) - 100, 6).alias("momentum"))


@plan("D45_latest_week", "SELECT w, n, round(100.0 * (n - lag(n) OVER (ORDER BY w)) / lag(n) OVER (ORDER BY w), 4)::DOUBLE AS change FROM (SELECT date_trunc('week', ts)::DATE AS w, count(*) AS n FROM events GROUP BY 1)")
def d45(t: Tables) -> DataFrame:
    weeks = t.events.groupBy(F.to_date(F.date_trunc("week", F.col("ts").cast("timestamp"))).alias("w")).agg(F.count("*").alias("n"))
    before = F.lag("n").over(Window.orderBy("w"))
    return weeks.withColumn("change", S.pct(F.col("n") - before, before, 4))


@plan("D47_hidden_vs_commercial", shares_sql(f"CASE WHEN {BUCKET} = 'Unlisted' THEN 'hidden' ELSE 'commercial' END AS side"), "companies")
def d47(t: Tables) -> DataFrame:
    return shares(t.companies, F.when(P.coverage_bucket() == "Unlisted", "hidden").otherwise("commercial").alias("side"))


@plan("E01_stats", "SELECT count(*) AS total, count(*) FILTER (WHERE ai_score >= 0.6) AS ai, count(DISTINCT country) FILTER (WHERE country NOT ILIKE '%remote%') AS countries FROM companies", "companies")
def e01(t: Tables) -> DataFrame:
    named = F.when(~F.col("country").ilike("%remote%"), F.col("country"))
    return t.companies.agg(F.count("*").alias("total"), F.count_if(F.col("ai_score") >= 0.6).alias("ai"), F.countDistinct(named).alias("countries"))


@plan("E02_company_page", "SELECT c.id, c.name, d.round_type FROM companies c LEFT JOIN (SELECT company_id, arg_min(round_type, (deal_date, deal_id)) AS round_type FROM deals GROUP BY 1) d ON d.company_id = c.id WHERE c.name ILIKE '%00001%' ORDER BY c.ai_score DESC NULLS LAST, c.id LIMIT 20 OFFSET 20", "companies", "deals")
def e02(t: Tables) -> DataFrame:
    first = t.deals.groupBy("company_id").agg(F.min_by("round_type", F.struct("deal_date", "deal_id")).alias("round_type"))
    page = t.companies.filter(F.col("name").ilike("%00001%")).orderBy(F.desc_nulls_last("ai_score"), "id").offset(20).limit(20)
    return page.join(first, F.col("company_id") == F.col("id"), "left").select("id", "name", "round_type")


@plan("E03_founding_years", "SELECT founded_year, count(*) AS n FROM companies GROUP BY 1", "companies")
def e03(t: Tables) -> DataFrame:
    return t.companies.groupBy("founded_year").agg(F.count("*").alias("n"))


@plan("E04_locations", "SELECT country, count(*) AS n FROM companies WHERE ai_score >= 0.1 AND country NOT ILIKE '%remote%' GROUP BY 1", "companies")
def e04(t: Tables) -> DataFrame:
    return t.companies.filter((F.col("ai_score") >= 0.1) & ~F.col("country").ilike("%remote%")).groupBy("country").agg(F.count("*").alias("n"))


@plan("G01_weekly_report", "SELECT country, segment, n FROM (SELECT country, segment, count(*) AS n, row_number() OVER (PARTITION BY country ORDER BY count(*) DESC, segment) AS k FROM companies WHERE country IN (SELECT country FROM companies GROUP BY 1 ORDER BY count(*) DESC, country LIMIT 10) GROUP BY 1, 2) WHERE k <= 3", "companies")
def g01(t: Tables) -> DataFrame:
    c = t.companies
    top = c.groupBy("country").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "country").limit(10).select("country")
    rows = c.join(F.broadcast(top), "country", "left_semi").groupBy("country", "segment").agg(F.count("*").alias("n"))
    return top_per_key(rows, ["country"], [F.desc("n"), F.col("segment")], 3)
