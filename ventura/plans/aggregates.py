"""Filters and aggregations over the firm model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ventura.functions import predicates as P
from ventura.functions.stats import entropy, hhi, pct
from ventura.plans.catalogue import plan
from ventura.plans.model import Tables

AI = "(cb_ai_tagged OR ai_score >= 0.5 OR ai_mentioned OR llm_ai_verified)"
BUCKET = "CASE verification_status WHEN 'verified_cb' THEN 'A' WHEN 'verified_pb' THEN 'B' ELSE 'Unlisted' END"
YEAR = "coalesce(founded_year, cohort_year, grant_first_award_year, nullif(web_first_seen_year, 0))"


@plan("F01_is_ai", f"SELECT {AI} AS is_ai, count(*) AS n FROM companies GROUP BY 1", "companies")
def f01(t: Tables) -> DataFrame:
    return t.companies.groupBy(P.is_ai().alias("is_ai")).agg(F.count("*").alias("n"))


@plan("F02_ai_variants", """
SELECT v AS variant, count(*) FILTER (WHERE p) AS ai, count(p) AS known FROM (
  SELECT unnest(['canonical', 'no_mention', 'pre_llm', 'mention', 'evidence']) AS v,
    unnest([cb_ai_tagged OR ai_score >= 0.5 OR ai_mentioned OR llm_ai_verified, cb_ai_tagged OR ai_score >= 0.5 OR llm_ai_verified,
      cb_ai_tagged OR ai_score >= 0.5 OR ai_mentioned, ai_mentioned, cb_ai_tagged OR llm_ai_verified]) AS p FROM companies) GROUP BY 1""", "companies")  # fmt: skip
def f02(t: Tables) -> DataFrame:
    flags = F.array(*(F.struct(F.lit(k).alias("variant"), v.alias("p")) for k, v in P.ai_variants().items()))
    return t.companies.select(F.inline(flags)).groupBy("variant").agg(F.count_if("p").alias("ai"), F.count("p").alias("known"))


@plan("F03_dynamic_conjunction", f"""
SELECT id, country, total_raised FROM companies WHERE region = 'ASIA' AND total_raised >= 2000000 AND {AI} AND segment IN ('MACHINERY', 'BUILDING')""", "companies")  # fmt: skip
def f03(t: Tables) -> DataFrame:
    wanted = {"region": "ASIA", "least_raised": 2_000_000, "ai": True, "segments": ["MACHINERY", "BUILDING"]}
    clauses = {
        "region": lambda v: F.col("region") == v,
        "least_raised": lambda v: F.col("total_raised") >= v,
        "ai": lambda v: P.is_ai() if v else F.lit(True),
        "segments": lambda v: F.col("segment").isin(v),
    }
    return t.companies.filter(reduce(lambda a, b: a & b, (clauses[k](v) for k, v in wanted.items()))).select("id", "country", "total_raised")


@plan("F04_search", "SELECT id, name FROM companies WHERE name ILIKE '%r#00000001%' OR segment ILIKE '%mach%'", "companies")
def f04(t: Tables) -> DataFrame:
    return t.companies.filter(F.col("name").ilike("%r#00000001%") | F.col("segment").ilike("%mach%")).select("id", "name")


@plan("F05_negative_search", "SELECT country, count(*) AS n FROM companies WHERE country NOT ILIKE '%_1%' GROUP BY 1", "companies")
def f05(t: Tables) -> DataFrame:
    return t.companies.filter(~F.col("country").ilike("%_1%")).groupBy("country").agg(F.count("*").alias("n"))


@plan("F06_array_overlap", """
SELECT company_id, list_sort(list(tag)) AS tags FROM firm_tags GROUP BY 1 HAVING list_has_any(list(tag), ['ECONOMY', 'PROMO'])""", "firm_tags")  # fmt: skip
def f06(t: Tables) -> DataFrame:
    tags = t.firm_tags.groupBy("company_id").agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    return tags.filter(F.coalesce(F.arrays_overlap("tags", F.array(F.lit("ECONOMY"), F.lit("PROMO"))), F.lit(False)))


@plan("F07_tag_member", """
SELECT company_id FROM firm_tags GROUP BY 1 HAVING list_contains(list(tag), 'SMALL')""", "firm_tags")
def f07(t: Tables) -> DataFrame:
    return t.firm_tags.groupBy("company_id").agg(F.collect_set("tag").alias("tags")).filter(F.array_contains("tags", "SMALL")).select("company_id")


@plan("F08_guards", "SELECT id, domain FROM companies WHERE founded_year BETWEEN 2005 AND 2015 AND domain IS NOT NULL AND domain <> '' AND segment IN ('HOUSEHOLD', 'FURNITURE')", "companies")
def f08(t: Tables) -> DataFrame:
    return t.companies.filter(F.col("founded_year").between(2005, 2015) & F.col("domain").isNotNull() & (F.col("domain") != "") & F.col("segment").isin("HOUSEHOLD", "FURNITURE")).select("id", "domain")


@plan("F09_non_empty_array", "SELECT company_id, count(*) AS n_tags FROM firm_tags GROUP BY 1 HAVING count(*) > 3", "firm_tags")
def f09(t: Tables) -> DataFrame:
    return t.firm_tags.groupBy("company_id").agg(F.collect_set("tag").alias("tags")).filter(F.size("tags") > 3).select("company_id", F.size("tags").cast("long").alias("n_tags"))


@plan("F10_case_buckets", f"""
SELECT {BUCKET} AS bucket, CASE WHEN verification_status = 'verified_cb_pb' THEN 'both' WHEN verification_status = 'verified_cb' THEN 'cb_only' WHEN verification_status = 'verified_pb' THEN 'pb_only' ELSE 'hidden' END AS strict,
  count(*) AS n FROM companies GROUP BY 1, 2""", "companies")  # fmt: skip
def f10(t: Tables) -> DataFrame:
    return t.companies.groupBy(P.coverage_bucket().alias("bucket"), P.strict_bucket().alias("strict")).agg(F.count("*").alias("n"))


@plan("F11_denylist", "SELECT id, domain FROM companies WHERE NOT (lower(trim(name)) IN ('customer#000000003') OR coalesce(split_part(domain, '.', 1), '') IN ('firm7', 'firm9'))", "companies")
def f11(t: Tables) -> DataFrame:
    denied = F.lower(F.trim("name")).isin("customer#000000003") | F.coalesce(F.split_part("domain", F.lit("."), F.lit(1)), F.lit("")).isin("firm7", "firm9")
    return t.companies.filter(~denied).select("id", "domain")


@plan("F12_drop_non_startups", "SELECT s_suppkey, s_name FROM supplier WHERE NOT regexp_matches(lower(s_name), 'capital|fund|#0000000[0-9]1') AND string_split(s_name, '#')[1] <> 'University'")
def f12(t: Tables) -> DataFrame:
    return t.supplier.filter(~F.lower("s_name").rlike("capital|fund|#0000000[0-9]1") & (F.split("s_name", "#")[0] != "University")).select("s_suppkey", "s_name")


@plan("F13_text_available", "SELECT lang, count(*) AS n FROM documents WHERE length(text) >= 80 GROUP BY 1")
def f13(t: Tables) -> DataFrame:
    return t.documents.filter(F.length("text") >= 80).groupBy("lang").agg(F.count("*").alias("n"))


@plan("F14_hash_sample", f"""
SELECT bucket, id FROM (SELECT {BUCKET} AS bucket, id, row_number() OVER (PARTITION BY {BUCKET} ORDER BY md5(CAST(id AS VARCHAR)), id) AS k FROM companies) WHERE k <= 25""", "companies")  # fmt: skip
def f14(t: Tables) -> DataFrame:
    rows = t.companies.select(P.coverage_bucket().alias("bucket"), "id")
    k = F.row_number().over(Window.partitionBy("bucket").orderBy(F.md5(F.col("id").cast("string")), "id"))
    return rows.withColumn("k", k).filter("k <= 25").select("bucket", "id")


@plan("F15_seeded_sample")
def f15(t: Tables) -> DataFrame:
    """A reproducible Bernoulli sample: the hash decides, so it doesn't depend on partitions."""
    return t.companies.filter(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1000)) < 100).select("id", "name")


@plan("F16_category_predicate", "SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%ring%' OR lower(p_type) LIKE '%promo%'")
def f16(t: Tables) -> DataFrame:
    return t.part.filter(F.lower("p_name").contains("ring") | F.lower("p_type").contains("promo")).select("p_partkey")


@plan("F17_keyword_predicates", "SELECT doc_id, lower(text) LIKE '% in %' AS spaced, (lower(text) LIKE '%in-%' OR lower(text) LIKE '%the %') AS dashed FROM documents")
def f17(t: Tables) -> DataFrame:
    low = F.lower("text")
    return t.documents.select("doc_id", low.contains(" in ").alias("spaced"), (low.contains("in-") | low.contains("the ")).alias("dashed"))


@plan("F18_import_chain", """
SELECT id FROM companies WHERE region IN ('ASIA', 'EUROPE') AND operating_status IN ('active', 'ipo') AND founded_year >= 2005 AND (cb_ai_tagged OR ai_score >= 0.3)""", "companies")
def f18(t: Tables) -> DataFrame:
    rows = t.companies.filter(F.col("region").isin("ASIA", "EUROPE")).filter(F.col("operating_status").isin("active", "ipo")).filter("founded_year >= 2005")
    return rows.filter(F.col("cb_ai_tagged") | (F.col("ai_score") >= 0.3)).select("id")


@plan("F19_tag_floor", f"""
SELECT tag, count(*) FILTER (WHERE {YEAR} >= 2015) AS recent, count(*) FILTER (WHERE {YEAR} < 2015) AS prior FROM firm_tags JOIN companies ON company_id = id
GROUP BY 1 HAVING count(*) FILTER (WHERE {YEAR} >= 2015) >= 50 AND count(*) FILTER (WHERE {YEAR} < 2015) >= 15""", "companies", "firm_tags")  # fmt: skip
def f19(t: Tables) -> DataFrame:
    rows = t.firm_tags.join(t.companies, F.col("company_id") == F.col("id")).withColumn("y", P.effective_year())
    return rows.groupBy("tag").agg(F.count_if(F.col("y") >= 2015).alias("recent"), F.count_if(F.col("y") < 2015).alias("prior")).filter("recent >= 50 AND prior >= 15")


@plan("F20_min_cell", f"SELECT country, count(*) AS n, count(*) FILTER (WHERE {AI}) AS ai FROM companies GROUP BY 1 HAVING count(*) >= 55", "companies")
def f20(t: Tables) -> DataFrame:
    return t.companies.groupBy("country").agg(F.count("*").alias("n"), F.count_if(P.is_ai()).alias("ai")).filter("n >= 55")


@plan("A01_A02_filtered_share", f"SELECT region, count(*) AS n, count(*) FILTER (WHERE {AI}) AS ai, round(100.0 * count(*) FILTER (WHERE {AI}) / count(*), 1)::DOUBLE AS ai_pct FROM companies GROUP BY 1", "companies")
def a01(t: Tables) -> DataFrame:
    return t.companies.groupBy("region").agg(F.count("*").alias("n"), F.count_if(P.is_ai()).alias("ai")).withColumn("ai_pct", pct(F.col("ai"), F.col("n")))


@plan("A03_count_distinct", f"SELECT count(DISTINCT country) AS countries, count(DISTINCT country) FILTER (WHERE {AI}) AS ai_countries, count(DISTINCT domain) AS domains FROM companies", "companies")
def a03(t: Tables) -> DataFrame:
    return t.companies.agg(F.countDistinct("country").alias("countries"), F.countDistinct(F.when(P.is_ai(), F.col("country"))).alias("ai_countries"), F.countDistinct("domain").alias("domains"))


@plan("A04_having", f"SELECT segment, region, count(*) AS n FROM companies GROUP BY 1, 2 HAVING count(*) FILTER (WHERE {AI}) >= 20", "companies")
def a04(t: Tables) -> DataFrame:
    return t.companies.groupBy("segment", "region").agg(F.count("*").alias("n"), F.count_if(P.is_ai()).alias("ai")).filter("ai >= 20").drop("ai")


@plan("A05_exact_median", "SELECT round_type, quantile_cont(deal_size, 0.5) AS median_size, count(*) AS n FROM deals GROUP BY 1", "deals")
def a05(t: Tables) -> DataFrame:
    return t.deals.groupBy("round_type").agg(F.percentile("deal_size", 0.5).alias("median_size"), F.count("*").alias("n"))


@plan("A06_field_coverage", "SELECT field, n, filled, 100.0 * filled / n AS coverage FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS n, count({c}) AS filled FROM companies" for c in ("domain", "ai_score", "llm_ai_verified", "founded_year", "total_raised", "naics_code")) + ")", "companies")
def a06(t: Tables) -> DataFrame:
    fields = ("domain", "ai_score", "llm_ai_verified", "founded_year", "total_raised", "naics_code")
    one = t.companies.agg(F.count("*").alias("n"), *(F.count(c).alias(c) for c in fields))
    return one.unpivot("n", list(fields), "field", "filled").select("field", "n", "filled", (100 * F.col("filled").cast("double") / F.col("n")).alias("coverage"))


@plan("A07_bool_or", "SELECT company_id, bool_or(deal_size > 400000) AS any_large FROM deals GROUP BY 1", "deals")
def a07(t: Tables) -> DataFrame:
    return t.deals.groupBy("company_id").agg(F.bool_or(F.col("deal_size") > 400000).alias("any_large"))


@plan("A08_ordered_list", "SELECT company_id, list(deal_id ORDER BY deal_date, deal_id) AS deal_ids FROM deals GROUP BY 1", "deals")
def a08(t: Tables) -> DataFrame:
    rows = t.deals.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("deal_date", "deal_id"))).alias("d"))
    return rows.select("company_id", F.col("d.deal_id").alias("deal_ids"))


@plan("A09_decoded_min", "SELECT company_id, min(deal_year) FILTER (WHERE deal_year BETWEEN 1996 AND 2026) AS first_year FROM deals GROUP BY 1", "deals")
def a09(t: Tables) -> DataFrame:
    return t.deals.groupBy("company_id").agg(F.min(F.when(F.col("deal_year").between(1996, 2026), F.col("deal_year"))).alias("first_year"))


@plan("A10_two_level", "SELECT first_year, round_type, count(*) AS firms FROM (SELECT company_id, round_type, min(deal_year) AS first_year FROM deals GROUP BY 1, 2) GROUP BY 1, 2", "deals")
def a10(t: Tables) -> DataFrame:
    return t.deals.groupBy("company_id", "round_type").agg(F.min("deal_year").alias("first_year")).groupBy("first_year", "round_type").agg(F.count("*").alias("firms"))


@plan("A11_first_and_extreme", "SELECT company_id, arg_min(round_rank, (deal_date, round_rank)) AS first_rank, max(round_rank) AS max_rank, count(*) AS n_rounds FROM deals GROUP BY 1", "deals")
def a11(t: Tables) -> DataFrame:
    return t.deals.groupBy("company_id").agg(F.min_by("round_rank", F.struct("deal_date", "round_rank")).alias("first_rank"), F.max("round_rank").alias("max_rank"), F.count("*").alias("n_rounds"))


@plan("A12_supported_mode", """
SELECT country, segment, c AS support FROM (SELECT country, segment, count(*) AS c, sum(count(*)) OVER (PARTITION BY country) AS n,
  row_number() OVER (PARTITION BY country ORDER BY count(*) DESC, segment) AS k FROM companies GROUP BY 1, 2) WHERE k = 1 AND n >= 15 AND c >= 0.2 * n""", "companies")  # fmt: skip
def a12(t: Tables) -> DataFrame:
    w = Window.partitionBy("country")
    rows = t.companies.groupBy("country", "segment").agg(F.count("*").alias("support"))
    rows = rows.select("*", F.sum("support").over(w).alias("n"), F.row_number().over(w.orderBy(F.desc("support"), "segment")).alias("k"))
    return rows.filter("k = 1 AND n >= 15 AND support >= 0.2 * n").select("country", "segment", "support")


@plan("A13_highest_degree", """
SELECT l_suppkey, max(CASE WHEN regexp_matches(p_name, 'ring|gear') THEN 3 WHEN regexp_matches(p_name, 'widget') THEN 2 WHEN regexp_matches(p_name, 'bolt') THEN 1 ELSE 0 END) AS top
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")  # fmt: skip
def a13(t: Tables) -> DataFrame:
    level = F.when(F.col("p_name").rlike("ring|gear"), 3).when(F.col("p_name").rlike("widget"), 2).when(F.col("p_name").rlike("bolt"), 1).otherwise(0)
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey").agg(F.max(level).alias("top"))


@plan("A14_merge_fold", """
SELECT company_id, min(deal_year) AS first_year, arg_min(round_type, (deal_date, deal_id)) AS first_type, bool_or(status = 'F') AS any_final, list_sort(list(DISTINCT round_type)) AS types FROM deals GROUP BY 1""", "deals")
def a14(t: Tables) -> DataFrame:
    return t.deals.groupBy("company_id").agg(
        F.min("deal_year").alias("first_year"), F.min_by("round_type", F.struct("deal_date", "deal_id")).alias("first_type"),
        F.bool_or(F.col("status") == "F").alias("any_final"), F.array_sort(F.collect_set("round_type")).alias("types"),
    )


@plan("A15_crosstab_pct", """
SELECT region, 100.0 * count(*) FILTER (WHERE segment = 'BUILDING') / count(*) AS building, 100.0 * count(*) FILTER (WHERE segment = 'MACHINERY') / count(*) AS machinery FROM companies GROUP BY 1""", "companies")
def a15(t: Tables) -> DataFrame:
    wide = t.companies.groupBy("region").pivot("segment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]).count().na.fill(0)
    total = reduce(lambda a, b: a + b, (F.col(c) for c in wide.columns[1:]))
    return wide.select("region", (100.0 * F.col("BUILDING") / total).alias("building"), (100.0 * F.col("MACHINERY") / total).alias("machinery"))


@plan("A16_pivot", "SELECT deal_year, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s.lower()}" for s in "FOP") + " FROM deals GROUP BY 1", "deals")
def a16(t: Tables) -> DataFrame:
    return t.deals.groupBy("deal_year").pivot("status", ["F", "O", "P"]).count().na.fill(0).toDF("deal_year", "f", "o", "p")


@plan("A17_share_within", "SELECT region, segment, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY region) AS share FROM companies GROUP BY 1, 2", "companies")
def a17(t: Tables) -> DataFrame:
    return t.companies.groupBy("region", "segment").agg(F.count("*").alias("n")).withColumn("share", 100 * F.col("n").cast("double") / F.sum("n").over(Window.partitionBy("region")))


@plan("A18_share_of_total", f"SELECT country, count(*) FILTER (WHERE {AI}) AS ai, 100.0 * count(*) FILTER (WHERE {AI}) / sum(count(*) FILTER (WHERE {AI})) OVER () AS share FROM companies GROUP BY 1", "companies")
def a18(t: Tables) -> DataFrame:
    rows = t.companies.groupBy("country").agg(F.count_if(P.is_ai()).alias("ai"))
    return rows.withColumn("share", 100 * F.col("ai").cast("double") / F.sum("ai").over(Window.partitionBy()))


@plan("A19_predicate_dimension", f"""
SELECT v AS variant, bucket, count(*) AS n, count(*) FILTER (WHERE p) AS ai FROM (SELECT {BUCKET} AS bucket, unnest(['canonical', 'no_mention', 'pre_llm', 'mention', 'evidence']) AS v,
  unnest([{AI}, cb_ai_tagged OR ai_score >= 0.5 OR llm_ai_verified, cb_ai_tagged OR ai_score >= 0.5 OR ai_mentioned, ai_mentioned, cb_ai_tagged OR llm_ai_verified]) AS p FROM companies) GROUP BY 1, 2""", "companies")  # fmt: skip
def a19(t: Tables) -> DataFrame:
    flags = F.array(*(F.struct(F.lit(k).alias("variant"), v.alias("p")) for k, v in P.ai_variants().items()))
    return t.companies.select(P.coverage_bucket().alias("bucket"), F.inline(flags)).groupBy("variant", "bucket").agg(F.count("*").alias("n"), F.count_if("p").alias("ai"))


@plan("A20_multi_slice", f"""
SELECT field, has, count(*) AS n, count(*) FILTER (WHERE {AI}) AS ai FROM (SELECT *, unnest(['domain', 'founded_year', 'total_raised', 'naics_code']) AS field,
  unnest([domain IS NOT NULL, founded_year IS NOT NULL, total_raised IS NOT NULL, naics_code IS NOT NULL]) AS has FROM companies) GROUP BY 1, 2""", "companies")  # fmt: skip
def a20(t: Tables) -> DataFrame:
    slices = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).isNotNull().alias("has")) for c in ("domain", "founded_year", "total_raised", "naics_code")))
    return t.companies.select(P.is_ai().alias("ai"), F.inline(slices)).groupBy("field", "has").agg(F.count("*").alias("n"), F.count_if("ai").alias("ai"))


@plan("A21_unnest_group", f"SELECT tag, count(*) AS n, count(*) FILTER (WHERE {AI}) AS ai FROM firm_tags JOIN companies ON company_id = id GROUP BY 1", "companies", "firm_tags")
def a21(t: Tables) -> DataFrame:
    lists = t.firm_tags.groupBy("company_id").agg(F.collect_list("tag").alias("tags"))
    return lists.join(t.companies, F.col("company_id") == F.col("id")).select(P.is_ai().alias("p"), F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"), F.count_if("p").alias("ai"))


@plan("A22_split_unnest", "SELECT word, count(*) AS n FROM (SELECT trim(unnest(string_split(p_name, ' '))) AS word FROM part) WHERE word <> '' GROUP BY 1")
def a22(t: Tables) -> DataFrame:
    return t.part.select(F.explode(F.split("p_name", " ")).alias("word")).select(F.trim("word").alias("word")).filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


@plan("A23_rollup", "SELECT region, country, count(*) AS n FROM companies GROUP BY ROLLUP (region, country)", "companies")
def a23(t: Tables) -> DataFrame:
    return t.companies.rollup("region", "country").agg(F.count("*").alias("n"))


@plan("A24_histogram", """
SELECT b AS bucket, coalesce(n, 0) AS n FROM range(10) AS r(b) LEFT JOIN (SELECT least(floor(ai_score * 10), 9)::BIGINT AS k, count(*) AS n FROM companies WHERE ai_score IS NOT NULL GROUP BY 1) ON k = b""", "companies")  # fmt: skip
def a24(t: Tables) -> DataFrame:
    counted = t.companies.filter("ai_score IS NOT NULL").groupBy(F.least(F.floor(F.col("ai_score") * 10), F.lit(9)).alias("bucket")).agg(F.count("*").alias("n"))
    return t.spark.range(10).withColumnRenamed("id", "bucket").join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


@plan("A25_bands", f"SELECT CASE WHEN {YEAR} <= 2009 THEN '<=2009' WHEN {YEAR} <= 2014 THEN '2010-14' WHEN {YEAR} <= 2019 THEN '2015-19' WHEN {YEAR} <= 2100 THEN '2020+' END AS band, count(*) AS n FROM companies GROUP BY 1", "companies")
def a25(t: Tables) -> DataFrame:
    return t.companies.groupBy(P.cohort_band(P.effective_year()).alias("band")).agg(F.count("*").alias("n"))


@plan("A26_conditional_aggs", "SELECT difficulty, count(*) FILTER (WHERE status = 'success') AS good, count(*) FILTER (WHERE status = 'error') AS bad, max(finished_at) FILTER (WHERE status = 'success') AS last_good FROM runs GROUP BY 1", "runs")
def a26(t: Tables) -> DataFrame:
    good = F.col("status") == "success"
    return t.runs.groupBy("difficulty").agg(F.count_if(good).alias("good"), F.count_if(F.col("status") == "error").alias("bad"), F.max(F.when(good, F.col("finished_at"))).alias("last_good"))


@plan("A27_rates_by_tier", """
SELECT tier, count(*) AS sites, sum(n) AS runs, round(100.0 * sum(good) / sum(n), 4) AS success_pct FROM (SELECT site, max(difficulty) AS tier, count(*) AS n, count(*) FILTER (WHERE status = 'success') AS good FROM runs GROUP BY 1) GROUP BY 1""", "runs")  # fmt: skip
def a27(t: Tables) -> DataFrame:
    site = t.runs.groupBy("site").agg(F.max("difficulty").alias("tier"), F.count("*").alias("n"), F.count_if(F.col("status") == "success").alias("good"))
    return site.groupBy("tier").agg(F.count("*").alias("sites"), F.sum("n").alias("runs"), pct(F.sum("good"), F.sum("n"), 4).alias("success_pct"))


@plan("A28_confusion", """
SELECT lang, count(*) FILTER (WHERE p AND y) AS tp, count(*) FILTER (WHERE p AND NOT y) AS fp, count(*) FILTER (WHERE NOT p AND y) AS fn, count(*) FILTER (WHERE NOT p AND NOT y) AS tn
FROM (SELECT lang, quality = 1 AS y, length(text) >= 600 AS p FROM documents JOIN labels USING (doc_id)) GROUP BY 1""")  # fmt: skip
def a28(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id").select("lang", (F.col("quality") == 1).alias("y"), (F.length("text") >= 600).alias("p"))
    p, y = F.col("p"), F.col("y")
    return rows.groupBy("lang").agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))


@plan("A29_collisions", "SELECT count(*) AS names, sum(n) AS exposed FROM (SELECT domain, count(*) AS n FROM companies WHERE domain IS NOT NULL GROUP BY 1 HAVING count(DISTINCT name) > 1)", "companies")
def a29(t: Tables) -> DataFrame:
    return t.companies.filter("domain IS NOT NULL").groupBy("domain").agg(F.countDistinct("name").alias("k"), F.count("*").alias("n")).filter("k > 1").agg(F.count("*").alias("names"), F.sum("n").alias("exposed"))


@plan("A30_mixed_groups", "SELECT country FROM companies GROUP BY 1 HAVING min(CAST(ai_mentioned AS INT)) <> max(CAST(ai_mentioned AS INT))", "companies")
def a30(t: Tables) -> DataFrame:
    return t.companies.groupBy("country").agg((F.min("ai_mentioned") != F.max("ai_mentioned")).alias("mixed")).filter("mixed").select("country")


@plan("A31_threshold_sweep", "SELECT tau, count(*) FILTER (WHERE ai_score >= tau) AS n FROM companies, (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS tau) GROUP BY 1", "companies")
def a31(t: Tables) -> DataFrame:
    taus = F.array(*map(F.lit, (0.1, 0.3, 0.5, 0.7, 0.9)))
    return t.companies.select("ai_score", F.explode(taus).alias("tau")).groupBy("tau").agg(F.count_if(F.col("ai_score") >= F.col("tau")).alias("n"))


@plan("A32_transition_matrix", f"SELECT cb_ai_tagged AS a, ai_mentioned AS b, llm_ai_verified AS c, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS share FROM companies GROUP BY 1, 2, 3", "companies")
def a32(t: Tables) -> DataFrame:
    rows = t.companies.groupBy(F.col("cb_ai_tagged").alias("a"), F.col("ai_mentioned").alias("b"), F.col("llm_ai_verified").alias("c")).agg(F.count("*").alias("n"))
    return rows.withColumn("share", 100 * F.col("n").cast("double") / F.sum("n").over(Window.partitionBy()))


@plan("A33_graduation", """
SELECT first_rank, count(*) AS firms, round(avg(CAST(top >= 2 AS INT)), 6) AS reached_2, round(avg(CAST(top >= 4 AS INT)), 6) AS reached_4 FROM (
  SELECT company_id, arg_min(round_rank, (deal_date, round_rank)) AS first_rank, max(round_rank) AS top FROM deals GROUP BY 1) GROUP BY 1""", "deals")  # fmt: skip
def a33(t: Tables) -> DataFrame:
    firm = t.deals.groupBy("company_id").agg(F.min_by("round_rank", F.struct("deal_date", "round_rank")).alias("first_rank"), F.max("round_rank").alias("top"))
    share = lambda k: F.round(F.avg((F.col("top") >= k).cast("int")), 6)
    return firm.groupBy("first_rank").agg(F.count("*").alias("firms"), share(2).alias("reached_2"), share(4).alias("reached_4"))


@plan("A34_serial_investors", """
SELECT n_firms, count(*) AS investors FROM (SELECT investor_id, count(DISTINCT company_id) AS n_firms FROM edges JOIN deals ON round_id = deal_id GROUP BY 1) GROUP BY 1""", "edges", "deals")  # fmt: skip
def a34(t: Tables) -> DataFrame:
    own = t.edges.join(t.deals, F.col("round_id") == F.col("deal_id")).groupBy("investor_id").agg(F.countDistinct("company_id").alias("n_firms"))
    return own.groupBy("n_firms").agg(F.count("*").alias("investors"))


@plan("A35_failure_taxonomy", """
SELECT CASE WHEN status ILIKE 'err%' AND seconds > 50 THEN 'timeout' WHEN status ILIKE 'err%' THEN 'error' WHEN status ILIKE '%zero%' THEN 'empty' ELSE 'ok' END AS kind, count(*) AS n FROM runs GROUP BY 1""", "runs")
def a35(t: Tables) -> DataFrame:
    s = F.col("status")
    kind = F.when(s.ilike("err%") & (F.col("seconds") > 50), "timeout").when(s.ilike("err%"), "error").when(s.ilike("%zero%"), "empty").otherwise("ok")
    return t.runs.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@plan("M05_concentration", f"""
SELECT y, sum(ai) AS ai, round(sum(s * s), 8) AS hhi, round(-sum(CASE WHEN s > 0 THEN s * ln(s) ELSE 0 END), 6) AS entropy FROM (
  SELECT {YEAR} AS y, country, count(*) FILTER (WHERE {AI}) AS ai, count(*) FILTER (WHERE {AI})::DOUBLE / nullif(sum(count(*) FILTER (WHERE {AI})) OVER (PARTITION BY {YEAR}), 0) AS s
  FROM companies GROUP BY 1, 2) GROUP BY 1 HAVING sum(ai) >= 10""", "companies")  # fmt: skip
def m05(t: Tables) -> DataFrame:
    rows = t.companies.groupBy(P.effective_year().alias("y"), "country").agg(F.count_if(P.is_ai()).alias("ai"))
    rows = rows.withColumn("s", F.try_divide(F.col("ai").cast("double"), F.sum("ai").over(Window.partitionBy("y")).cast("double")))
    return rows.groupBy("y").agg(F.sum("ai").alias("ai"), F.round(hhi(F.col("s")), 8).alias("hhi"), F.round(entropy(F.col("s")), 6).alias("entropy")).filter("ai >= 10")
