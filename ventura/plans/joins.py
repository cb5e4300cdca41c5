"""Joins over the firm model."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ventura.functions import predicates as P
from ventura.functions.text import normalize_company_name, simple_domain
from ventura.operators import joins as J
from ventura.operators import similarity as S
from ventura.plans.aggregates import AI, BUCKET, YEAR
from ventura.plans.catalogue import plan
from ventura.plans.model import Tables
from ventura.plans.scalars import FULL_SQL, alike_sql, name_sql, sorted_sql


@plan("J01_fact_to_dimension", f"SELECT round_type, count(*) AS n, count(*) FILTER (WHERE {AI}) AS ai FROM deals JOIN companies ON company_id = id GROUP BY 1", "companies", "deals")
def j01(t: Tables) -> DataFrame:
    return t.deals.join(t.companies, F.col("company_id") == F.col("id")).groupBy("round_type").agg(F.count("*").alias("n"), F.count_if(P.is_ai()).alias("ai"))


@plan("J02_existence_flag", "SELECT region, count(*) AS n, count(s.company_id) AS funded FROM companies LEFT JOIN (SELECT DISTINCT company_id FROM deals WHERE deal_size > 450000) s ON s.company_id = id GROUP BY 1", "companies", "deals")
def j02(t: Tables) -> DataFrame:
    funded = t.deals.filter("deal_size > 450000").select("company_id").distinct()
    return t.companies.join(funded, F.col("company_id") == F.col("id"), "left").groupBy("region").agg(F.count("*").alias("n"), F.count("company_id").alias("funded"))


@plan("J03_exists_in_case", """
SELECT CASE WHEN EXISTS (SELECT 1 FROM deals WHERE company_id = id AND deal_size > 450000) THEN 'financing' WHEN naics_code IS NOT NULL THEN 'grants' WHEN incubator_source = 'accelerator' THEN 'accelerator' ELSE 'other' END AS channel, count(*) AS n
FROM companies GROUP BY 1""", "companies", "deals")  # fmt: skip
def j03(t: Tables) -> DataFrame:
    funded = t.deals.filter("deal_size > 450000").select("company_id").distinct()
    rows = t.companies.join(funded, F.col("company_id") == F.col("id"), "left")
    return rows.groupBy(P.channel(F.col("company_id").isNotNull()).alias("channel")).agg(F.count("*").alias("n"))


@plan("J04_semi_join", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT deal_id FROM deals WHERE round_type = '1-URGENT' AND deal_year = 1997) GROUP BY 1", "deals")
def j04(t: Tables) -> DataFrame:
    wanted = t.deals.filter("round_type = '1-URGENT' AND deal_year = 1997").select(F.col("deal_id").alias("l_orderkey"))
    return t.lineitem.join(wanted, "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@plan("J05_anti_join", "SELECT id, name FROM companies WHERE NOT EXISTS (SELECT 1 FROM deals WHERE company_id = id AND deal_size > 200000)", "companies", "deals")
def j05(t: Tables) -> DataFrame:
    return t.companies.join(t.deals.filter("deal_size > 200000"), F.col("company_id") == F.col("id"), "left_anti").select("id", "name")


@plan("J06_missing_rows", """
SELECT k, min(id) AS id FROM (SELECT id, coalesce(lower(domain), 'n:' || lower(name)) AS k FROM companies WHERE region = 'ASIA')
WHERE k NOT IN (SELECT coalesce(lower(domain), 'n:' || lower(name)) FROM companies WHERE region = 'EUROPE') GROUP BY 1""", "companies")  # fmt: skip
def j06(t: Tables) -> DataFrame:
    c = t.companies
    rows = J.missing_rows(c.filter("region = 'ASIA'"), c.filter("region = 'EUROPE'"))
    return rows.select(J.identity_key(F.col("domain"), F.col("name")).alias("k"), "id")


@plan("J07_lateral_top1", """
SELECT id, d.deal_id, l.l_partkey FROM companies LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY deal_date DESC, deal_id) AS k FROM deals) d ON d.company_id = id AND d.k = 1
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS k FROM lineitem) l ON l.l_orderkey = d.deal_id AND l.k = 1""", "companies", "deals")  # fmt: skip
def j07(t: Tables) -> DataFrame:
    latest = J.top_per_key(t.deals, ["company_id"], [F.desc("deal_date"), F.col("deal_id")]).select("company_id", "deal_id")
    top = J.top_per_key(t.lineitem, ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey")]).select("l_orderkey", "l_partkey")
    rows = t.companies.select("id").join(latest, F.col("company_id") == F.col("id"), "left")
    return rows.join(top, F.col("l_orderkey") == F.col("deal_id"), "left").select("id", "deal_id", "l_partkey")


@plan("J08_left_panel", """
SELECT a.company_id, a.n AS n99, b.n AS n98, c.n AS n97 FROM (SELECT company_id, count(*) AS n FROM deals WHERE deal_year = 1999 GROUP BY 1) a
LEFT JOIN (SELECT company_id, count(*) AS n FROM deals WHERE deal_year = 1998 GROUP BY 1) b USING (company_id) LEFT JOIN (SELECT company_id, count(*) AS n FROM deals WHERE deal_year = 1997 GROUP BY 1) c USING (company_id)""", "deals")  # fmt: skip
def j08(t: Tables) -> DataFrame:
    counts = t.deals.filter("deal_year IN (1997, 1998, 1999)").groupBy("company_id").pivot("deal_year", [1999, 1998, 1997]).count().toDF("company_id", "n99", "n98", "n97")
    return counts.filter("n99 IS NOT NULL")


@plan("J09_inner_panel", """
SELECT a.dom, a.n + b.n + c.n AS n FROM (SELECT domain AS dom, count(*) AS n FROM companies WHERE region = 'ASIA' GROUP BY 1) a JOIN (SELECT domain AS dom, count(*) AS n FROM companies WHERE region = 'EUROPE' GROUP BY 1) b USING (dom)
JOIN (SELECT domain AS dom, count(*) AS n FROM companies WHERE region = 'AMERICA' GROUP BY 1) c USING (dom)""", "companies")  # fmt: skip
def j09(t: Tables) -> DataFrame:
    regions = t.companies.filter("domain IS NOT NULL AND region IN ('ASIA', 'EUROPE', 'AMERICA')").groupBy("domain").agg(F.countDistinct("region").alias("k"), F.count("*").alias("n"))
    return regions.filter("k = 3").select(F.col("domain").alias("dom"), "n")


@plan("J10_star", f"SELECT investor_id, deal_year, count(*) AS rounds, count(*) FILTER (WHERE {AI}) AS ai_rounds FROM edges JOIN deals ON round_id = deal_id LEFT JOIN companies ON company_id = id GROUP BY 1, 2", "companies", "deals", "edges")
def j10(t: Tables) -> DataFrame:
    rows = t.edges.join(t.deals, F.col("round_id") == F.col("deal_id")).join(t.companies, F.col("company_id") == F.col("id"), "left")
    return rows.groupBy("investor_id", "deal_year").agg(F.count("*").alias("rounds"), F.count_if(P.is_ai()).alias("ai_rounds"))


@plan("J11_as_of_velocity", """
SELECT s.event_id, s.stars - p.stars AS delta FROM snapshots s LEFT JOIN LATERAL (SELECT stars FROM snapshots b WHERE b.repo = s.repo AND b.collected_at <= s.collected_at - INTERVAL 7 DAY ORDER BY b.collected_at DESC, b.stars DESC LIMIT 1) p ON true""", "snapshots")
def j11(t: Tables) -> DataFrame:
    return J.as_of_backward(t.snapshots, "repo", "collected_at", "stars", timedelta(days=7)).select("event_id", (F.col("stars") - F.col("prior")).alias("delta"))


_NORM = "nullif(trim(regexp_replace(lower(name), '[^\\w\\s\\-]', ' ', 'g')), '')"


@plan("J12_entity_match", f"""
SELECT s_suppkey, coalesce(d.id, n.id) AS match_id FROM (SELECT s_suppkey, 'firm' || CAST(s_suppkey AS VARCHAR) || '.example.com' AS domain, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE replace(s_name, 'Supplier', 'Customer') END AS name FROM supplier) r
LEFT JOIN (SELECT domain, min(id) AS id FROM companies WHERE domain IS NOT NULL GROUP BY 1) d ON lower(r.domain) = d.domain
LEFT JOIN (SELECT {_NORM} AS nn, min(id) AS id FROM companies GROUP BY 1) n ON {_NORM.replace('name', 'r.name')} = n.nn""", "companies")  # fmt: skip
def j12(t: Tables) -> DataFrame:
    """Against all firms; a third of the names match none."""
    firms = t.companies.select("id", "domain", normalize_company_name(F.col("name")).alias("normalized_name"))
    name = F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).otherwise(F.replace("s_name", F.lit("Supplier"), F.lit("Customer")))
    records = t.supplier.select("s_suppkey", F.concat(F.lit("firm"), F.col("s_suppkey").cast("string"), F.lit(".example.com")).alias("domain"), normalize_company_name(name).alias("normalized_name"))
    return J.match_entities(records, firms).select("s_suppkey", "match_id")


_ASKED = "SELECT s_suppkey AS id, concat('Custommer#', substr(s_name, 10), CASE WHEN s_suppkey % 2 = 0 THEN ' Inc.' ELSE '' END) AS name, CASE WHEN s_suppkey % 3 > 0 THEN upper(n_name) END AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey"
_PREPARED = "SELECT id, left(norm, 1) AS block, " + sorted_sql("norm") + " AS x, lower(country) AS country FROM (SELECT id, " + name_sql("name", FULL_SQL) + " AS norm, country FROM {})"


@plan("J13_fuzzy_match", f"""
SELECT s_suppkey, match_id, round(similarity, 6) AS similarity FROM (
  SELECT a.id AS s_suppkey, b.id AS match_id, {alike_sql('a.x', 'b.x')} AS similarity
  FROM ({_PREPARED.format(f"({_ASKED})")}) a JOIN ({_PREPARED.format("companies")}) b
    ON a.block = b.block AND levenshtein(a.x, b.x) <= 0.05 * (length(a.x) + length(b.x)) + 1e-9 AND (a.country IS NULL OR b.country IS NULL OR a.country = b.country))
WHERE similarity >= 0.95 QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY similarity DESC, match_id) = 1""", "companies")  # fmt: skip
def j13(t: Tables) -> DataFrame:
    """Best firm for each supplier's name, misspelt, within first characters at 0.95; no match across known countries."""
    asked = t.spark.sql(_ASKED.replace("FROM supplier JOIN nation", "FROM {supplier} JOIN {nation}"), supplier=t.supplier, nation=t.nation)
    found = S.best_matches(asked, t.companies.select("id", "name", "country"))
    return found.select(F.col("id").alias("s_suppkey"), "match_id", F.round("similarity", 6).alias("similarity"))


_UNPLACED = "SELECT id, CASE WHEN id % 4 = 0 THEN concat(name, ', Inc.') WHEN id % 51 = 0 THEN 'Customer Group 42' ELSE name END AS name FROM companies WHERE domain IS NULL"


@plan("J14_duplicate_report", f"""
, c AS (SELECT x, min(id) AS id, count(*) AS copies FROM (SELECT id, {sorted_sql('norm')} AS x FROM (SELECT id, {name_sql('name', FULL_SQL)} AS norm FROM ({_UNPLACED}))) WHERE x <> '' GROUP BY x)
SELECT a, b, copies_a, copies_b, round(similarity, 6) AS similarity FROM (
  SELECT a.id AS a, b.id AS b, a.copies AS copies_a, b.copies AS copies_b, {alike_sql('a.x', 'b.x')} AS similarity FROM c a JOIN c b ON a.id < b.id AND levenshtein(a.x, b.x) <= 0.08 * (length(a.x) + length(b.x)) + 1e-9)
WHERE similarity >= 0.92 UNION ALL SELECT id, NULL, copies, NULL, 1.0 FROM c WHERE copies > 1""", "companies")  # fmt: skip
def j14(t: Tables) -> DataFrame:
    """Likely duplicates among all firms without a domain at 0.92, as pairs of classes of equal normalised names."""
    unplaced = t.spark.sql(_UNPLACED.replace("FROM companies", "FROM {companies}"), companies=t.companies)
    return S.duplicate_report(unplaced, "id", "name").withColumn("similarity", F.round("similarity", 6))


@plan("J15_later_event", """
SELECT a.company_id, a.d AS first_a, b.d AS first_b FROM (SELECT company_id, min(deal_date) AS d FROM deals WHERE round_rank = 0 GROUP BY 1) a JOIN (SELECT company_id, min(deal_date) AS d FROM deals WHERE round_rank = 4 GROUP BY 1) b USING (company_id) WHERE b.d > a.d""", "deals")
def j15(t: Tables) -> DataFrame:
    first = lambda k: F.min(F.when(F.col("round_rank") == k, F.col("deal_date")))
    return t.deals.groupBy("company_id").agg(first(0).alias("first_a"), first(4).alias("first_b")).filter("first_b > first_a")


@plan("J16_outer_ranked", """
SELECT coalesce(a.tag, b.tag) AS tag, coalesce(a.n, 0) AS all_n, coalesce(b.n, 0) AS ai_n FROM (SELECT tag, count(*) AS n FROM firm_tags GROUP BY 1 ORDER BY n DESC, tag LIMIT 4) a
FULL JOIN (SELECT tag, count(*) AS n FROM firm_tags JOIN companies ON company_id = id WHERE cb_ai_tagged GROUP BY 1 ORDER BY n DESC, tag LIMIT 4) b ON a.tag = b.tag""", "companies", "firm_tags")  # fmt: skip
def j16(t: Tables) -> DataFrame:
    every = t.firm_tags.groupBy("tag").agg(F.count("*").alias("all_n")).orderBy(F.desc("all_n"), "tag").limit(4)
    ai = t.firm_tags.join(t.companies.filter("cb_ai_tagged"), F.col("company_id") == F.col("id")).groupBy("tag").agg(F.count("*").alias("ai_n")).orderBy(F.desc("ai_n"), "tag").limit(4)
    return every.join(ai, "tag", "full").na.fill(0)


@plan("J17_dictionary", "SELECT id, CASE segment WHEN 'MACHINERY' THEN 'deep' WHEN 'BUILDING' THEN 'built' WHEN 'HOUSEHOLD' THEN 'home' END AS label FROM companies", "companies")
def j17(t: Tables) -> DataFrame:
    labels = F.create_map(*map(F.lit, ("MACHINERY", "deep", "BUILDING", "built", "HOUSEHOLD", "home")))
    return t.companies.select("id", F.try_element_at(labels, F.col("segment")).alias("label"))


@plan("J18_domain_bridge", r"""
SELECT p.page_id, count(p2.page_id) AS peers FROM (SELECT page_id, lower(split_part(regexp_replace(url, '^(https?://)?(www\.)?', ''), '/', 1)) AS d FROM pages) p
JOIN (SELECT page_id, lower(split_part(regexp_replace(url, '^(https?://)?(www\.)?', ''), '/', 1)) AS d FROM pages) p2 USING (d) GROUP BY 1""")  # fmt: skip
def j18(t: Tables) -> DataFrame:
    sites = t.pages.select("page_id", simple_domain(F.col("url")).alias("d"))
    return sites.join(sites.groupBy("d").agg(F.count("*").alias("peers")), "d").select("page_id", "peers")


_COS = "list_cosine_similarity(embedding::DOUBLE[], centroid)"


@plan("J19_nearest_centroid", f"""
SELECT vec_id, arg_max(c.label, (round({_COS}, 9), -c.label)) AS nearest, round(max({_COS}), 5) AS cosine FROM embeddings e, (
  SELECT label, list(m ORDER BY i) AS centroid FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1) c GROUP BY 1""")  # fmt: skip
def j19(t: Tables) -> DataFrame:
    e = t.embeddings
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centroids = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("ms")).select("label", F.col("ms.m").alias("centroid"))
    return J.nearest_centroid(e, centroids, "vec_id", "embedding").withColumn("cosine", F.round("cosine", 5))


@plan("J20_nearest_members")
def j20(t: Tables) -> DataFrame:
    """Eight members nearest to each cluster's mean."""
    e = t.embeddings
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centroids = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("ms")).select("label", F.col("ms.m").alias("centroid"))
    near = e.join(centroids, "label").select("label", "vec_id", J.cosine_to(F.col("embedding"), F.col("centroid")).alias("cosine"))
    return J.top_per_key(near, ["label"], [F.desc("cosine"), F.col("vec_id")], 8)


@plan("J21_set_operations", """
(SELECT company_id FROM deals WHERE deal_year = 1997 INTERSECT SELECT company_id FROM deals WHERE deal_year = 1998) EXCEPT SELECT company_id FROM deals WHERE deal_year = 1999""".replace("FROM deals", "FROM (SELECT o_custkey AS company_id, year(o_orderdate) AS deal_year FROM orders)"))
def j21(t: Tables) -> DataFrame:
    year = lambda y: t.deals.filter(F.col("deal_year") == y).select("company_id")
    return year(1997).intersect(year(1998)).subtract(year(1999))
