"""The firm model over the driver tables: one definition per view, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ventura.session import ship

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Views in order; a view may read driver tables and views above it.
VIEWS = {
    "companies": """
SELECT c.c_custkey AS id, c.c_name AS name, n.n_name AS country, r.r_name AS region, c.c_mktsegment AS segment,
  CASE WHEN c.c_custkey % 17 = 0 THEN NULL ELSE concat('firm', CAST(c.c_custkey % 997 AS STRING), '.example.com') END AS domain,
  CASE WHEN c.c_custkey % 10 < 4 THEN 'emerging_github' WHEN c.c_custkey % 10 < 7 THEN 'verified_cb' WHEN c.c_custkey % 10 < 9 THEN 'verified_pb' ELSE 'verified_cb_pb' END AS verification_status,
  c.c_mktsegment = 'MACHINERY' AS cb_ai_tagged,
  CASE WHEN c.c_acctbal < 0 THEN NULL ELSE c.c_acctbal / 10000 END AS ai_score,
  c.c_custkey % 11 = 0 AS ai_mentioned,
  CASE WHEN c.c_custkey % 7 = 0 THEN NULL ELSE c.c_custkey % 7 = 1 END AS llm_ai_verified,
  CASE WHEN c.c_custkey % 13 = 0 THEN NULL ELSE CAST(2000 + c.c_custkey % 26 AS INT) END AS founded_year,
  CASE WHEN c.c_custkey % 5 = 0 THEN CAST(2001 + c.c_custkey % 25 AS INT) END AS cohort_year,
  CASE WHEN c.c_custkey % 9 = 0 THEN CAST(2003 + c.c_custkey % 20 AS INT) END AS grant_first_award_year,
  CASE WHEN c.c_custkey % 19 = 0 THEN 0 WHEN c.c_custkey % 3 = 0 THEN CAST(2005 + c.c_custkey % 18 AS INT) END AS web_first_seen_year,
  CASE WHEN c.c_acctbal > 0 THEN c.c_acctbal * 1000 END AS total_raised,
  CASE WHEN c.c_custkey % 6 = 0 THEN 'accelerator' WHEN c.c_custkey % 6 = 1 THEN 'sbir' WHEN c.c_custkey % 6 = 2 THEN 'github' END AS incubator_source,
  CASE WHEN c.c_custkey % 8 = 0 THEN '541511' END AS naics_code,
  CASE WHEN c.c_custkey % 10 = 0 THEN 'closed' WHEN c.c_custkey % 10 = 1 THEN 'acquired' WHEN c.c_custkey % 10 = 2 THEN 'ipo' ELSE 'active' END AS operating_status
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "deals": """
SELECT o_orderkey AS deal_id, o_custkey AS company_id, o_orderdate AS deal_date, year(o_orderdate) AS deal_year, o_totalprice AS deal_size,
  o_orderpriority AS round_type, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS round_rank, o_orderstatus AS status FROM orders""",
    "firm_tags": """
SELECT DISTINCT o.o_custkey AS company_id, p.p_type AS tag FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey""",
    "edges": """
SELECT DISTINCT l.l_suppkey AS investor_id, l.l_orderkey AS round_id FROM lineitem l""",
    "founders": """
SELECT o_orderkey - o_orderkey % 3 AS person_id, o_custkey AS company_id FROM orders""",
    "people": """
SELECT o_orderkey AS person_id, CASE o_orderstatus WHEN 'F' THEN 'F' WHEN 'O' THEN 'M' END AS sex, o_totalprice / 500000 AS prestige FROM orders WHERE o_orderkey % 3 = 0""",
    "degrees": """
SELECT l.l_orderkey - l.l_orderkey % 3 AS person_id, p.p_brand AS institution, p.p_type AS subject,
  CASE l.l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE l.l_linenumber % 2 END AS level FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey""",
    "snapshots": """
SELECT user_id AS repo, event_id, ts AS collected_at, value AS stars FROM events WHERE event_type IN ('view', 'click')""",
    "runs": """
SELECT event_id, user_id AS site, ts AS finished_at, value AS seconds,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'zero_result' ELSE 'success' END AS status,
  CASE WHEN user_id % 3 = 0 THEN 'hard' ELSE 'easy' END AS difficulty FROM events""",
}
_NEEDS = {
    "companies": ("customer", "nation", "region"),
    "deals": ("orders",),
    "firm_tags": ("orders", "lineitem", "part"),
    "edges": ("lineitem",),
    "founders": ("orders",),
    "people": ("orders",),
    "degrees": ("lineitem", "part"),
    "snapshots": ("events",),
    "runs": ("events",),
}


class Tables:
    """Driver tables and views of one input folder as DataFrames: ``t.companies``, ``t.orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        ship(spark)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        needed = {t: getattr(self, t) for t in _NEEDS[name]}
        sql = VIEWS[name]
        for t in sorted(needed, key=len, reverse=True):
            for word in ("FROM", "JOIN"):
                sql = sql.replace(f"{word} {t} ", f"{word} {{{t}}} ")
                if sql.endswith(f"{word} {t}"):
                    sql = sql[: -len(t)] + f"{{{t}}}"
        return self.spark.sql(sql, **needed)


def oracle(sql: str, *views: str) -> str:
    """DuckDB SQL with the views it reads in front."""
    if not views:
        return sql
    return "WITH " + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in views) + "\n" + (sql if not sql.lstrip().upper().startswith("WITH ") else ", " + sql.lstrip()[5:])
