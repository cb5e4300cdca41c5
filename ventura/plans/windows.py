"""Windows, ordering and limits over the firm model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ventura.functions import predicates as P
from ventura.operators.joins import top_per_key
from ventura.plans.aggregates import AI, YEAR
from ventura.plans.catalogue import plan
from ventura.plans.model import Tables


@plan("W01_row_number", "SELECT company_id, deal_id FROM deals QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY (status = 'P'), deal_size DESC, deal_id) = 1", "deals")
def w01(t: Tables) -> DataFrame:
    return top_per_key(t.deals, ["company_id"], [F.col("status") == "P", F.desc("deal_size"), F.col("deal_id")]).select("company_id", "deal_id")


@plan("W02_distinct_on", "SELECT DISTINCT ON (company_id) company_id, round_type FROM deals ORDER BY company_id, deal_date, deal_id", "deals")
def w02(t: Tables) -> DataFrame:
    return t.deals.groupBy("company_id").agg(F.min_by("round_type", F.struct("deal_date", "deal_id")).alias("round_type"))


@plan("W03_share_of_all", "SELECT round_type, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM deals GROUP BY 1", "deals")
def w03(t: Tables) -> DataFrame:
    return t.deals.groupBy("round_type").agg(F.count("*").alias("n")).withColumn("share", F.col("n").cast("double") / F.sum("n").over(Window.partitionBy()))


@plan("W04_lag_months", "SELECT deal_id, date_diff('day', lag(deal_date) OVER (PARTITION BY company_id ORDER BY deal_date, deal_id), deal_date) / 30.44 AS months FROM deals", "deals")
def w04(t: Tables) -> DataFrame:
    w = Window.partitionBy("company_id").orderBy("deal_date", "deal_id")
    return t.deals.select("deal_id", (F.datediff("deal_date", F.lag("deal_date").over(w)).cast("double") / 30.44).alias("months"))


@plan("W05_cumulative", "SELECT m, n, sum(n) OVER (ORDER BY m) AS total FROM (SELECT strftime(deal_date, '%Y-%m') AS m, count(*) AS n FROM deals GROUP BY 1)", "deals")
def w05(t: Tables) -> DataFrame:
    months = t.deals.groupBy(F.date_format("deal_date", "yyyy-MM").alias("m")).agg(F.count("*").alias("n"))
    return months.withColumn("total", F.sum("n").over(Window.orderBy("m").rowsBetween(Window.unboundedPreceding, 0)))


@plan("W06_cumulative_distinct", """
SELECT m, sum(k) OVER (ORDER BY m) AS seen FROM (SELECT m, count(*) AS k FROM (SELECT company_id % 25 AS c, min(strftime(deal_date, '%Y-%m-%d')) AS m FROM deals GROUP BY 1) GROUP BY 1)""", "deals")
def w06(t: Tables) -> DataFrame:
    first = t.deals.groupBy((F.col("company_id") % 25).alias("c")).agg(F.min(F.date_format("deal_date", "yyyy-MM-dd")).alias("m"))
    return first.groupBy("m").agg(F.count("*").alias("k")).select("m", F.sum("k").over(Window.orderBy("m").rowsBetween(Window.unboundedPreceding, 0)).alias("seen"))


@plan("W07_keep_first", """
SELECT l_orderkey, list(l_suppkey ORDER BY k) AS first_investors FROM (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS k FROM lineitem) WHERE k <= 5 GROUP BY 1""")
def w07(t: Tables) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey"))
    rows = t.lineitem.select("l_orderkey", "l_suppkey", k.alias("k")).filter("k <= 5")
    return rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("k", "l_suppkey"))).alias("x")).select("l_orderkey", F.col("x.l_suppkey").alias("first_investors"))


@plan("W08_best_by_score", "SELECT domain, arg_max(id, (coalesce(ai_score, -1), -id)) AS id FROM companies WHERE domain IS NOT NULL GROUP BY 1", "companies")
def w08(t: Tables) -> DataFrame:
    return t.companies.filter("domain IS NOT NULL").groupBy("domain").agg(F.max_by("id", F.struct(F.coalesce("ai_score", F.lit(-1.0)), -F.col("id"))).alias("id"))


@plan("W09_min_max", """
SELECT repo, v, CASE WHEN hi = lo THEN CASE WHEN v > 0 THEN 0.5 ELSE 0.0 END ELSE (v - lo) / (hi - lo) END AS scaled FROM (SELECT repo, max(stars) AS v, max(max(stars)) OVER () AS hi, min(max(stars)) OVER () AS lo FROM snapshots GROUP BY 1)""", "snapshots")
def w09(t: Tables) -> DataFrame:
    every = Window.partitionBy()
    rows = t.snapshots.groupBy("repo").agg(F.max("stars").alias("v"))
    rows = rows.select("repo", "v", F.max("v").over(every).alias("hi"), F.min("v").over(every).alias("lo"))
    scaled = F.when(F.col("hi") == F.col("lo"), F.when(F.col("v") > 0, 0.5).otherwise(0.0)).otherwise((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return rows.select("repo", "v", scaled.alias("scaled"))


@plan("W10_last_complete_year", """
SELECT max(y) AS last_complete FROM (SELECT y, n, (SELECT median(b.n) FROM (SELECT deal_year AS y, count(*) AS n FROM deals GROUP BY 1) b WHERE b.y BETWEEN a.y - 3 AND a.y - 1) AS m,
  (SELECT count(*) FROM (SELECT deal_year AS y, count(*) AS n FROM deals GROUP BY 1) b WHERE b.y BETWEEN a.y - 3 AND a.y - 1) AS k FROM (SELECT deal_year AS y, count(*) AS n FROM deals GROUP BY 1) a) WHERE k = 3 AND n >= 0.5 * m""", "deals")  # fmt: skip
def w10(t: Tables) -> DataFrame:
    w = Window.orderBy("y").rangeBetween(-3, -1)
    rows = t.deals.groupBy(F.col("deal_year").alias("y")).agg(F.count("*").alias("n"))
    rows = rows.select("y", "n", F.percentile("n", 0.5).over(w).alias("m"), F.count("*").over(w).alias("k"))
    return rows.filter((F.col("k") == 3) & (F.col("n") >= 0.5 * F.col("m"))).agg(F.max("y").alias("last_complete"))


@plan("W11_rank_correlation", """
SELECT round(corr(ra, rb), 9) AS spearman FROM (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb
  FROM (SELECT company_id, count(*) AS a, max(round_rank) AS b FROM deals GROUP BY 1))""", "deals")  # fmt: skip
def w11(t: Tables) -> DataFrame:
    rows = t.deals.groupBy("company_id").agg(F.count("*").alias("a"), F.max("round_rank").alias("b"))
    return spearman(rows, "a", "b")


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of average ranks. Ranks come from the counts of distinct values, which are far fewer than the rows."""

    def ranked(c: str, name: str) -> DataFrame:
        counts = rows.groupBy(c).agg(F.count("*").alias("k"))
        before = F.sum("k").over(Window.orderBy(c).rowsBetween(Window.unboundedPreceding, -1))
        return counts.select(c, (F.coalesce(before, F.lit(0)) + (F.col("k") + 1) / 2).alias(name))

    return rows.join(ranked(a, "ra"), a).join(ranked(b, "rb"), b).agg(F.round(F.corr("ra", "rb"), 9).alias("spearman"))


@plan("W12_latest_two", "SELECT w, n FROM (SELECT date_trunc('week', ts)::DATE AS w, count(*) AS n FROM events GROUP BY 1) ORDER BY w DESC LIMIT 2")
def w12(t: Tables) -> DataFrame:
    weeks = t.events.groupBy(F.to_date(F.date_trunc("week", F.col("ts").cast("timestamp"))).alias("w")).agg(F.count("*").alias("n"))
    return weeks.orderBy(F.desc("w")).limit(2)


@plan("W13_share_of_peak", "SELECT deal_year, n, greatest(0, 1 - n::DOUBLE / max(n) OVER ()) AS gap FROM (SELECT deal_year, count(*) AS n FROM deals GROUP BY 1)", "deals")
def w13(t: Tables) -> DataFrame:
    rows = t.deals.groupBy("deal_year").agg(F.count("*").alias("n"))
    return rows.withColumn("gap", F.greatest(F.lit(0.0), 1 - F.col("n").cast("double") / F.max("n").over(Window.partitionBy())))


@plan("W14_top5_share", f"""
SELECT y, 100.0 * sum(n) FILTER (WHERE k <= 5) / sum(n) AS top5 FROM (SELECT {YEAR} AS y, country, count(*) AS n, row_number() OVER (PARTITION BY {YEAR} ORDER BY count(*) DESC, country) AS k FROM companies GROUP BY 1, 2) GROUP BY 1""", "companies")
def w14(t: Tables) -> DataFrame:
    rows = t.companies.groupBy(P.effective_year().alias("y"), "country").agg(F.count("*").alias("n"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("y").orderBy(F.desc("n"), "country")))
    return rows.groupBy("y").agg((100 * F.sum(F.when(F.col("k") <= 5, F.col("n"))).cast("double") / F.sum("n")).alias("top5"))


@plan("W15_ranking_functions", "SELECT s_suppkey, dense_rank() OVER (ORDER BY s_nationkey) AS d, percent_rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS p, ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS q, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS nxt FROM supplier")
def w15(t: Tables) -> DataFrame:
    """The rank over all rows is made of the distinct keys, one row a nation, and joined back."""
    own = Window.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey")
    keys = t.supplier.select("s_nationkey").distinct().withColumn("d", F.row_number().over(Window.orderBy("s_nationkey")))
    return t.supplier.join(keys, "s_nationkey").select("s_suppkey", "d", F.percent_rank().over(own).alias("p"), F.ntile(4).over(own).alias("q"), F.lead("s_suppkey").over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("nxt"))


@plan("T01_nulls_last", "SELECT id, ai_score FROM companies ORDER BY ai_score DESC NULLS LAST, id LIMIT 40", "companies")
def t01(t: Tables) -> DataFrame:
    return t.companies.select("id", "ai_score").orderBy(F.desc_nulls_last("ai_score"), "id").limit(40)


@plan("T02_pagination", f"SELECT id, name, (SELECT ceil(count(*) / 25.0) FROM companies WHERE {AI})::BIGINT AS pages FROM companies WHERE {AI} ORDER BY id LIMIT 25 OFFSET 50", "companies")
def t02(t: Tables) -> DataFrame:
    found = t.companies.filter(P.is_ai())
    pages = found.agg(F.ceil(F.count("*") / 25.0).cast("long").alias("pages"))
    page = found.select("id", "name").orderBy("id").offset(50).limit(25)
    return page.withColumn("_one", F.lit(1)).join(F.broadcast(pages.withColumn("_one", F.lit(1))), "_one").drop("_one")


@plan("T03_top_groups_rejoin", f"""
SELECT country, {YEAR} AS y, count(*) AS n FROM companies WHERE country IN (SELECT country FROM companies GROUP BY 1 ORDER BY count(*) DESC, country LIMIT 5) GROUP BY 1, 2""", "companies")
def t03(t: Tables) -> DataFrame:
    c = t.companies
    top = c.groupBy("country").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "country").limit(5).select("country")
    return c.join(F.broadcast(top), "country", "left_semi").groupBy("country", P.effective_year().alias("y")).agg(F.count("*").alias("n"))


@plan("T04_extremes", "SELECT arg_max(country, (n, country)) AS largest, arg_min(country, (n, country)) AS smallest FROM (SELECT country, count(*) AS n FROM companies GROUP BY 1)", "companies")
def t04(t: Tables) -> DataFrame:
    rows = t.companies.groupBy("country").agg(F.count("*").alias("n"))
    return rows.agg(F.max_by("country", F.struct("n", "country")).alias("largest"), F.min_by("country", F.struct("n", "country")).alias("smallest"))


@plan("T05_filter_then_head", "SELECT id FROM companies WHERE NOT regexp_matches(name, '[05]$') ORDER BY id DESC LIMIT 30", "companies")
def t05(t: Tables) -> DataFrame:
    return t.companies.filter(~F.col("name").rlike("[05]$")).select("id").orderBy(F.desc("id")).limit(30)


@plan("T06_union_all", "SELECT kind, count(*) AS n FROM (SELECT 'firm' AS kind FROM customer UNION ALL SELECT 'investor' FROM supplier) GROUP BY 1")
def t06(t: Tables) -> DataFrame:
    both = t.customer.select(F.lit("firm").alias("kind")).unionByName(t.supplier.select(F.lit("investor").alias("kind")))
    return both.groupBy("kind").agg(F.count("*").alias("n"))


@plan("T07_union_by_name", "SELECT c_custkey AS id, c_mktsegment AS segment, NULL::BIGINT AS rounds FROM customer UNION ALL SELECT s_suppkey, NULL, 1 FROM supplier")
def t07(t: Tables) -> DataFrame:
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    b = t.supplier.select(F.lit(1).cast("long").alias("rounds"), F.col("s_suppkey").alias("id"))
    return a.unionByName(b, allowMissingColumns=True)


@plan("T08_distinct", "SELECT DISTINCT country, segment FROM companies", "companies")
def t08(t: Tables) -> DataFrame:
    return t.companies.select("country", "segment").distinct()


@plan("T09_set_difference", "SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def t09(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).distinct().join(t.supplier.filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")), "k", "left_anti")
