"""Merges and sources over the firm model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ventura.functions.text import entity_key
from ventura.operators import merge as M
from ventura.plans.catalogue import plan
from ventura.plans.model import Tables

_BEST = "SELECT * FROM companies WHERE domain IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(domain) ORDER BY ai_score DESC NULLS LAST, id) = 1"


def _side(t: Tables, region: str) -> DataFrame:
    return M.batch_best(t.companies.filter((F.col("region") == region) & F.col("domain").isNotNull()), "domain", "ai_score", "id").select("domain", "name", "founded_year", "ai_score", "cb_ai_tagged", "verification_status")


def _sql_side(region: str) -> str:
    return f"(SELECT * FROM companies WHERE domain IS NOT NULL AND region = '{region}' QUALIFY row_number() OVER (PARTITION BY lower(domain) ORDER BY ai_score DESC NULLS LAST, id) = 1)"


_STATUS = """CASE WHEN (o.verification_status = 'verified_cb' AND n.verification_status = 'verified_pb') OR (o.verification_status = 'verified_pb' AND n.verification_status = 'verified_cb') THEN 'verified_cb_pb'
 WHEN (CASE WHEN n.verification_status = 'verified_cb_pb' THEN 3 WHEN n.verification_status IN ('verified_cb', 'verified_pb') THEN 2 WHEN n.verification_status = 'emerging_github' THEN 1 ELSE 0 END)
    > (CASE WHEN o.verification_status = 'verified_cb_pb' THEN 3 WHEN o.verification_status IN ('verified_cb', 'verified_pb') THEN 2 WHEN o.verification_status = 'emerging_github' THEN 1 ELSE 0 END) THEN n.verification_status
 ELSE coalesce(o.verification_status, n.verification_status) END"""


@plan("U01_gap_fill_upsert", f"""
SELECT coalesce(o.domain, n.domain) AS domain, coalesce(o.name, n.name) AS name, coalesce(o.founded_year, n.founded_year) AS founded_year,
  CASE WHEN o.ai_score IS NULL THEN n.ai_score WHEN n.ai_score IS NULL THEN o.ai_score ELSE greatest(o.ai_score, n.ai_score) END AS ai_score,
  coalesce(o.cb_ai_tagged, false) OR coalesce(n.cb_ai_tagged, false) AS cb_ai_tagged, {_STATUS} AS verification_status
FROM {_sql_side('ASIA')} o FULL JOIN {_sql_side('EUROPE')} n ON o.domain = n.domain""", "companies")  # fmt: skip
def u01(t: Tables) -> DataFrame:
    return M.upsert(_side(t, "ASIA"), _side(t, "EUROPE"), "domain", {"ai_score": "greatest", "cb_ai_tagged": "or", "verification_status": "status"})


@plan("U02_batch_best", f"SELECT id, domain FROM ({_BEST})", "companies")
def u02(t: Tables) -> DataFrame:
    return M.batch_best(t.companies, "domain", "ai_score", "id").filter("domain IS NOT NULL").select("id", "domain")


@plan("U03_status_lattice", f"SELECT o.verification_status AS a, n.verification_status AS b, {_STATUS} AS merged, count(*) AS n FROM companies o JOIN companies n ON n.id = o.id + 3 GROUP BY 1, 2, 3", "companies")
def u03(t: Tables) -> DataFrame:
    a = t.companies.select("id", F.col("verification_status").alias("a"))
    b = t.companies.select((F.col("id") - 3).alias("id"), F.col("verification_status").alias("b"))
    return a.join(b, "id").groupBy("a", "b", M.escalate(F.col("a"), F.col("b")).alias("merged")).agg(F.count("*").alias("n"))


@plan("U04_enrichment_upsert", """
SELECT coalesce(o.k, n.k) AS k, coalesce(n.v, o.v) AS v FROM (SELECT c_nationkey AS k, max(c_acctbal) AS v FROM customer GROUP BY 1) o FULL JOIN (SELECT s_nationkey AS k, CASE WHEN max(s_acctbal) > 5000 THEN max(s_acctbal) END AS v FROM supplier GROUP BY 1) n ON o.k = n.k""")
def u04(t: Tables) -> DataFrame:
    old = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_acctbal").alias("v"))
    new = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_acctbal").alias("m")).select("k", F.when(F.col("m") > 5000, F.col("m")).alias("v"))
    return M.upsert(old, new, "k", {"v": "new"})


@plan("U04_provenance_merge", """
SELECT user_id, json_extract(arg_max(props, event_id), '$.k')::BIGINT AS last_k, count(*) AS n FROM events GROUP BY 1""")
def u04b(t: Tables) -> DataFrame:
    """Later entries win key by key when the events' maps are merged."""
    rows = t.events.select("user_id", "event_id", F.from_json("props", "map<string,bigint>").alias("m"))
    entries = rows.select("user_id", "event_id", F.explode("m")).groupBy("user_id", "key").agg(F.max_by("value", "event_id").alias("value"))
    merged = entries.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m"))
    return merged.join(t.events.groupBy("user_id").agg(F.count("*").alias("n")), "user_id").select("user_id", F.col("m")["k"].alias("last_k"), "n")


@plan("U05_merge_duplicates", """
SELECT id, ai_score, founded_year, name, merged FROM (SELECT domain, arg_max(id, (coalesce(n, 0), coalesce(ai_score, -1), -id)) AS id, max(ai_score) AS ai_score, min(founded_year) AS founded_year, arg_max(name, (coalesce(n, 0), coalesce(ai_score, -1), -id)) AS name, count(*) AS merged
FROM companies LEFT JOIN (SELECT company_id, count(*) AS n FROM deals GROUP BY 1) ON company_id = id WHERE domain IS NOT NULL GROUP BY 1)""", "companies", "deals")  # fmt: skip
def u05(t: Tables) -> DataFrame:
    return M.merge_duplicates(t.companies, t.deals, F.col("domain"))[0]


@plan("U05_repointed_children", """
SELECT coalesce(k, company_id) AS company_id, count(*) AS n FROM deals LEFT JOIN (SELECT c.id, m.id AS k FROM companies c JOIN (SELECT domain, arg_max(id, (coalesce(n, 0), coalesce(ai_score, -1), -id)) AS id
  FROM companies LEFT JOIN (SELECT company_id, count(*) AS n FROM deals GROUP BY 1) ON company_id = id WHERE domain IS NOT NULL GROUP BY 1) m ON m.domain = c.domain) x ON x.id = company_id GROUP BY 1""", "companies", "deals")  # fmt: skip
def u05b(t: Tables) -> DataFrame:
    return M.merge_duplicates(t.companies, t.deals, F.col("domain"))[1].groupBy("company_id").agg(F.count("*").alias("n"))


@plan("U06_save_records", """
SELECT count(*) AS n, count(*) FILTER (WHERE score = 0.7) AS raised FROM (SELECT CASE WHEN cb_ai_tagged AND coalesce(ai_score, 0) < 0.6 THEN 0.7 ELSE ai_score END AS score FROM companies)""", "companies")
def u06(t: Tables) -> DataFrame:
    score = F.when(F.col("cb_ai_tagged") & (F.coalesce("ai_score", F.lit(0.0)) < 0.6), 0.7).otherwise(F.col("ai_score"))
    return t.companies.select(score.alias("score")).agg(F.count("*").alias("n"), F.count_if(F.col("score") == 0.7).alias("raised"))


@plan("U07_fill_missing", "SELECT c.id, coalesce(founded_year, y) AS founded_year FROM companies c LEFT JOIN (SELECT company_id, min(deal_year)::INT AS y FROM deals GROUP BY 1) ON company_id = c.id", "companies", "deals")
def u07(t: Tables) -> DataFrame:
    years = t.deals.groupBy(F.col("company_id").alias("id")).agg(F.min("deal_year").cast("int").alias("founded_year"))
    return M.fill_missing(t.companies.select("id", "founded_year"), years, "id", "founded_year")


@plan("U08_insert_new", "SELECT c_nationkey AS k, 'c' AS src FROM (SELECT DISTINCT c_nationkey FROM customer) UNION ALL SELECT s_nationkey, 's' FROM (SELECT DISTINCT s_nationkey FROM supplier) WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer)")
def u08(t: Tables) -> DataFrame:
    old = t.customer.select(F.col("c_nationkey").alias("k"), F.lit("c").alias("src")).distinct()
    return M.insert_new(old, t.supplier.select(F.col("s_nationkey").alias("k"), F.lit("s").alias("src")), ["k"])


@plan("U09_candidate_dedup")
def u09(t: Tables) -> DataFrame:
    rows = t.companies.select("id", "domain", "name", (F.col("id") % 50).alias("stars"), F.array(F.concat(F.lit("repo/"), (F.col("id") % 3).cast("string"))).alias("urls"))
    return M.candidate_dedup(rows, entity_key(F.col("domain"), F.col("name")), "id")


@plan("U10_validate_batch", """
SELECT user_id, n, valid, names, valid / n AS valid_ratio, 1 - names / n AS duplicate_ratio, round(0.4 + 0.4 * (valid / n) + 0.2 * (1 - (1 - names / n)), 6) AS score, n >= 5 AND valid / n >= 0.6 AND 1 - names / n <= 0.4 AS is_good
FROM (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE length(trim(props)) >= 9) AS valid, count(DISTINCT lower(trim(props))) AS names FROM events GROUP BY 1)""".replace("length(trim(props)) >= 9", "length(trim(props)) >= 2"))
def u10(t: Tables) -> DataFrame:
    return M.validate_batch(t.events, "user_id", "props")


@plan("U11_value_remap", "SELECT CASE country WHEN 'NATION_1' THEN 'One' WHEN 'NATION_2' THEN 'Two' ELSE country END AS country, count(*) AS n FROM companies GROUP BY 1", "companies")
def u11(t: Tables) -> DataFrame:
    names = F.create_map(*map(F.lit, ("NATION_1", "One", "NATION_2", "Two")))
    return t.companies.groupBy(F.coalesce(F.try_element_at(names, F.col("country")), F.col("country")).alias("country")).agg(F.count("*").alias("n"))


@plan("U12_portfolio_upsert", f"""
SELECT coalesce(o.domain, n.domain) AS domain, coalesce(nullif(n.name, ''), o.name) AS name FROM {_sql_side('AFRICA')} o FULL JOIN {_sql_side('AMERICA')} n ON o.domain = n.domain""", "companies")
def u12(t: Tables) -> DataFrame:
    return M.upsert(_side(t, "AFRICA"), _side(t, "AMERICA"), "domain", {"name": "new_text"}).select("domain", "name")


@plan("S01_pruned_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 49 AND l_shipdate >= TIMESTAMP '2000-06-01'")
def s01(t: Tables) -> DataFrame:
    return t.lineitem.filter((F.col("l_quantity") > 49) & (F.col("l_shipdate") >= F.lit("2000-06-01").cast("timestamp_ntz"))).select("l_orderkey", "l_quantity")


@plan("S02_in_list_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (3, 5, 8, 13, 21)")
def s02(t: Tables) -> DataFrame:
    return t.orders.filter(F.col("o_custkey").isin(3, 5, 8, 13, 21)).select("o_orderkey", "o_totalprice")


@plan("S10_sql_query", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def s10(t: Tables) -> DataFrame:
    return t.spark.sql("SELECT o_orderstatus, count(*) AS n FROM {orders} GROUP BY 1", orders=t.orders)


@plan("S11_keyset_page", "SELECT c_custkey, c_name FROM customer WHERE c_custkey >= 40 AND c_custkey < 90")
def s11(t: Tables) -> DataFrame:
    return t.customer.filter((F.col("c_custkey") >= 40) & (F.col("c_custkey") < 90)).select("c_custkey", "c_name")


@plan("S12_offset_page", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 40")
def s12(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_name").orderBy("c_custkey").offset(40).limit(20)


@plan("S17_resume", "SELECT DISTINCT site FROM runs WHERE site NOT IN (SELECT site FROM runs WHERE status = 'success' AND seconds > 100)", "runs")
def s17(t: Tables) -> DataFrame:
    done = t.runs.filter("status = 'success' AND seconds > 100").select("site")
    return t.runs.select("site").distinct().join(done, "site", "left_anti")


@plan("S21_views", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def s21(t: Tables) -> DataFrame:
    t.nation.createOrReplaceTempView("ventura_nation")
    return t.spark.table("ventura_nation").groupBy("n_regionkey").agg(F.count("*").alias("n"))


@plan("S22_in_memory_table", "SELECT r_name, w FROM region JOIN (VALUES (0, 1.5::DOUBLE), (1, 2.5::DOUBLE)) v(k, w) ON k = r_regionkey")
def s22(t: Tables) -> DataFrame:
    weights = t.spark.createDataFrame([(0, 1.5), (1, 2.5)], "k int, w double")
    return t.region.join(F.broadcast(weights), F.col("k") == F.col("r_regionkey")).select("r_name", "w")
