"""The remaining scalar functions and coverage reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ventura.functions import predicates as P
from ventura.functions import stats as S
from ventura.functions.text import LEGAL_SUFFIXES, normalize_company_name
from ventura.operators.similarity import OPTIONAL, domain_confidence
from ventura.plans.aggregates import AI, YEAR
from ventura.plans.catalogue import plan
from ventura.plans.model import Tables
from ventura.plans.reports import _CHANNEL, _FUNDED, _funded, shares, shares_sql
from ventura.plans.scalars import _SAMPLES, FULL_SQL, LEGAL_SQL, _samples, alike_sql, name_sql


@plan("P28_first_award_year", "SELECT id, CAST(nullif(regexp_extract(s, 'first award[^0-9]{0,6}((19|20)[0-9]{2})', 1), '') AS INT) AS y FROM (SELECT id, CASE WHEN id % 2 = 0 THEN 'first award: ' || CAST(1990 + id % 40 AS VARCHAR) ELSE 'award 2001' END AS s FROM companies)", "companies")
def p28(t: Tables) -> DataFrame:
    s = F.when(F.col("id") % 2 == 0, F.concat(F.lit("first award: "), (1990 + F.col("id") % 40).cast("string"))).otherwise("award 2001")
    return t.companies.select("id", F.nullif(F.regexp_extract(s, r"first award\D{0,6}((19|20)\d{2})", 1), F.lit("")).try_cast("int").alias("y"))


_LABEL = "split_part(split_part(split_part(url, '://', 2), '/', 1), '.', {})"
_FOUND = f"""SELECT page_id, page_id % 5 AS rank, concat(label, '.com') AS domain, CASE page_id % 4 WHEN 0 THEN concat(upper(label), ' AI') WHEN 1 THEN concat(label, 'x') WHEN 2 THEN concat('x', label) ELSE concat(label, ' holding') END AS name
  FROM (SELECT page_id, CASE WHEN {_LABEL.format(1)} IN ('www', 'm', 'blog') THEN {_LABEL.format(2)} ELSE {_LABEL.format(1)} END AS label FROM pages)"""
_CUT = ", ".join(f"CASE WHEN ends_with(v, '{x}') AND length(v) > {len(x) + 2} THEN left(v, length(v) - {len(x)}) END" for x in OPTIONAL)


@plan("P42_domain_resolution", f"""
SELECT page_id, round(max(score) - 0.01 * any_value(rank), 6) AS score FROM (SELECT page_id, rank, CASE WHEN v = '' OR label = '' THEN NULL WHEN v = label THEN 0.92
    WHEN starts_with(label, v) OR starts_with(v, label) THEN CASE WHEN least(length(v), length(label)) >= 0.6 * greatest(length(v), length(label)) THEN 0.78 END
    WHEN {alike_sql('v', 'label')} >= 0.88 THEN 0.7 * {alike_sql('v', 'label')} END AS score
  FROM (SELECT page_id, rank, label, unnest([v, {_CUT}]) AS v FROM (SELECT page_id, rank, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS v, regexp_replace(left(domain, length(domain) - 4), '[^a-z0-9]', '', 'g') AS label FROM ({_FOUND}))))
GROUP BY page_id HAVING round(max(score) - 0.01 * any_value(rank), 6) >= 0.55""")  # fmt: skip
def p42(t: Tables) -> DataFrame:
    """Confidence of each page's domain for a name spelt close to it, the pages standing as search results of ranks 0 to 4; the floor is 0.55."""
    found = t.spark.sql(_FOUND.replace("FROM pages", "FROM {pages}"), pages=t.pages)
    return found.select("page_id", F.round(domain_confidence(F.col("name"), F.col("domain"), F.col("rank")), 6).alias("score")).filter("score >= 0.55")


@plan("K21_country_growth", f"SELECT country, count(*) FILTER (WHERE {YEAR} BETWEEN 2000 AND 2010 AND {AI}) AS early, count(*) FILTER (WHERE {YEAR} > 2010 AND {AI}) AS late FROM companies GROUP BY 1 HAVING count(*) >= 40", "companies")
def k21(t: Tables) -> DataFrame:
    y, ai = P.effective_year(), P.is_ai()
    return t.companies.groupBy("country").agg(F.count_if(y.between(2000, 2010) & ai).alias("early"), F.count_if((y > 2010) & ai).alias("late"), F.count("*").alias("n")).filter("n >= 40").drop("n")


@plan("K22_cohort_home_share", f"SELECT {YEAR} AS y, round(100.0 * count(*) FILTER (WHERE {AI} AND region = 'AMERICA') / nullif(count(*) FILTER (WHERE {AI}), 0), 4)::DOUBLE AS home FROM companies GROUP BY 1", "companies")
def k22(t: Tables) -> DataFrame:
    ai = P.is_ai()
    return t.companies.groupBy(P.effective_year().alias("y")).agg(S.pct(F.count_if(ai & (F.col("region") == "AMERICA")), F.count_if(ai), 4).alias("home"))


@plan("K26_novelty_by_tier", shares_sql("CASE WHEN incubator_source IN ('sbir', 'accelerator') THEN 'curated' WHEN incubator_source IS NULL THEN 'none' ELSE 'open' END AS tier", interval=True), "companies")
def k26(t: Tables) -> DataFrame:
    s = F.col("incubator_source")
    return shares(t.companies, F.when(s.isin("sbir", "accelerator"), "curated").when(s.isNull(), "none").otherwise("open").alias("tier"), interval=True)


@plan("K27_cost_by_tier", "SELECT difficulty, count(*) AS runs, round(avg(seconds), 4) AS mean_seconds, round(corr(seconds, CAST(status = 'success' AS INT)), 8) AS r FROM runs GROUP BY 1", "runs")
def k27(t: Tables) -> DataFrame:
    good = (F.col("status") == "success").cast("double")
    return t.runs.groupBy("difficulty").agg(F.count("*").alias("runs"), F.round(F.avg("seconds"), 4).alias("mean_seconds"), F.round(F.corr("seconds", good), 8).alias("r"))


@plan("K43_mode_distortion", "SELECT founded_year AS y, count(*) AS before, count(*) + CASE WHEN row_number() OVER (ORDER BY count(*) DESC, founded_year) = 1 THEN (SELECT count(*) - count(founded_year) FROM companies) ELSE 0 END AS after FROM companies WHERE founded_year IS NOT NULL GROUP BY 1", "companies")
def k43(t: Tables) -> DataFrame:
    """What filling missing years with the commonest one does to the distribution."""
    years = t.companies.groupBy("founded_year").agg(F.count("*").alias("before"))
    known = years.filter("founded_year IS NOT NULL").withColumn("k", F.row_number().over(Window.orderBy(F.desc("before"), "founded_year")))
    missing = years.agg(F.coalesce(F.sum(F.when(F.col("founded_year").isNull(), F.col("before"))), F.lit(0)).alias("missing")).withColumn("one", F.lit(1))
    rows = known.withColumn("one", F.lit(1)).join(F.broadcast(missing), "one")
    return rows.select(F.col("founded_year").alias("y"), "before", (F.col("before") + F.when(F.col("k") == 1, F.col("missing")).otherwise(0)).alias("after"))


@plan("K51_normaliser_comparison", f"""
SELECT normaliser, count(*) AS keys, CAST(sum(n) AS BIGINT) AS firms FROM (SELECT normaliser, key, count(*) AS n FROM (
  SELECT 'full' AS normaliser, {name_sql("p_name || ' ' || lower(p_type) || ' labs'", FULL_SQL)} AS key FROM part UNION ALL
  SELECT 'conservative', {name_sql("p_name || ' ' || lower(p_type) || ' labs'", LEGAL_SQL)} FROM part) GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1""")
def k51(t: Tables) -> DataFrame:
    """Names that collide under each of the two normalisers."""
    names = t.part.select(F.concat("p_name", F.lit(" "), F.lower("p_type"), F.lit(" labs")).alias("name"), "p_partkey")
    both = names.select(F.inline(F.array(*(F.struct(F.lit(k).alias("normaliser"), normalize_company_name(F.col("name"), *v).alias("key"), F.col("p_partkey").alias("id")) for k, v in (("full", ()), ("conservative", (LEGAL_SUFFIXES,)))))))
    groups = both.groupBy("normaliser", "key").agg(F.count("*").alias("n")).filter("n > 1")
    return groups.groupBy("normaliser").agg(F.count("*").alias("keys"), F.sum("n").alias("firms"))


@plan("K61_performance", "SELECT round(tp::DOUBLE / nullif(tp + fp, 0), 8) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 8) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 8) AS f1 FROM (SELECT count(*) FILTER (WHERE p AND y) AS tp, count(*) FILTER (WHERE p AND NOT y) AS fp, count(*) FILTER (WHERE NOT p AND y) AS fn FROM (SELECT quality = 1 AS y, length(text) >= 600 AS p FROM documents JOIN labels USING (doc_id)))")
def k61(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id").select((F.col("quality") == 1).alias("y"), (F.length("text") >= 600).alias("p"))
    p, y = F.col("p"), F.col("y")
    cells = rows.agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"))
    precision, recall, f1 = S.precision_recall(F.col("tp"), F.col("fp"), F.col("fn"))
    return cells.select(F.round(precision, 8).alias("precision"), F.round(recall, 8).alias("recall"), F.round(f1, 8).alias("f1"))


@plan("D28_coverage_by_country", f"SELECT country, {_CHANNEL} AS channel, count(*) AS n, max({YEAR}) AS latest FROM {_FUNDED} GROUP BY 1, 2", "companies", "deals")
def d28(t: Tables) -> DataFrame:
    return _funded(t).groupBy("country", P.channel(F.col("funded")).alias("channel")).agg(F.count("*").alias("n"), F.max(P.effective_year()).alias("latest"))
