"""Sources and sinks: each query writes a driver table through a sink and reads it back through a reader."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ventura.plans.catalogue import plan
from ventura.plans.model import Tables
from ventura.session import shared_dir
from ventura.sources import files, sinks


def _folder(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/ventura-{name}-{uuid.uuid4().hex}"


@plan("S03_parquet_glob", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE year(o_orderdate) % 2 = 0 GROUP BY 1")
def s03(t: Tables) -> DataFrame:
    """Files of even years alone, by a glob over folders of years."""
    folder = _folder(t, "glob")
    t.orders.withColumn("y", F.year("o_orderdate")).repartition("y").write.partitionBy("y").parquet(folder)
    rows = t.spark.read.option("basePath", folder).parquet(f"{folder}/y=*[02468]")
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@plan("S04_delimited_text", "SELECT c_mktsegment, count(*) AS n, count(*) FILTER (WHERE c_custkey % 10 = 0) AS quoted FROM customer GROUP BY 1")
def s04(t: Tables) -> DataFrame:
    """A dump whose columns are all text, quotes inside it standing for themselves."""
    folder = _folder(t, "dump")
    name = F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit('"'), "c_name")).otherwise(F.col("c_name"))
    t.customer.select(F.concat_ws("|", F.col("c_custkey").cast("string"), name, "c_mktsegment").alias("value")).write.text(folder)
    rows = files.read_delimited(t.spark, folder, ["id", "name", "segment"], header=False)
    return rows.groupBy(F.col("segment").alias("c_mktsegment")).agg(F.count("*").alias("n"), F.count_if(F.col("name").startswith('"')).alias("quoted"))


@plan("S05_inferred_csv", "SELECT n_regionkey, sum(n_nationkey) AS keys, count(DISTINCT n_name) AS names FROM nation GROUP BY 1")
def s05(t: Tables) -> DataFrame:
    folder = _folder(t, "auto")
    t.nation.write.option("header", True).csv(folder)
    return files.read_inferred(t.spark, folder).groupBy("n_regionkey").agg(F.sum("n_nationkey").alias("keys"), F.countDistinct("n_name").alias("names"))


@plan("S06_award_fold", "SELECT lower(replace(c_name, '#', ' ')) AS key, count(*) AS awards, min(year(o_orderdate))::INT AS first_year, max(year(o_orderdate))::INT AS last_year, list_sort(list(DISTINCT o_orderstatus)) AS states FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def s06(t: Tables) -> DataFrame:
    """Orders as an award file, folded to one record per firm."""
    folder = _folder(t, "awards")
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    rows.select(F.concat("c_name", F.lit(", Inc.")).alias("company"), F.year("o_orderdate").cast("string").alias("award_year"), F.lit("").alias("company_website"), F.col("o_orderstatus").alias("state")).write.option("header", True).csv(folder)
    return files.fold_awards(t.spark, folder).select("key", "awards", "first_year", "last_year", "states")


@plan("S08_feeds", "SELECT concat('site', n_nationkey, '.com') AS domain, CASE WHEN n_nationkey % 3 = 0 THEN 1 WHEN n_nationkey % 2 = 0 THEN 2 WHEN n_nationkey % 5 = 0 THEN 3 ELSE 4 END AS feed FROM nation")
def s08(t: Tables) -> DataFrame:
    """Four feeds that name each other's sites again; the first that has one keeps it."""
    folder, url = _folder(t, "feeds"), F.concat(F.lit("https://www.site"), F.col("n_nationkey").cast("string"), F.lit(".com/p?x=1"))
    rows = t.nation.select("n_nationkey", url.alias("url"))
    rows.filter("n_nationkey % 3 = 0").select("url").write.option("header", True).csv(f"{folder}/csv")
    rows.filter("n_nationkey % 2 = 0").select(F.concat(F.lit("- [a]("), "url", F.lit(") b")).alias("value")).write.text(f"{folder}/md")
    rows.filter("n_nationkey % 5 = 0").select("url").write.json(f"{folder}/json")
    rows.select(F.concat(F.lit("version: 1\nseed_urls:\n- "), "url", F.lit(" # own\n")).alias("value")).repartition(25, "value").write.option("lineSep", "---\n").text(f"{folder}/yaml")
    return files.read_feeds(t.spark, f"{folder}/csv", f"{folder}/md", f"{folder}/json", f"{folder}/yaml").select("domain", "feed")


@plan("S09_nested_site_files", "SELECT concat('host', s_suppkey, '.vc') AS domain, s_suppkey::INT AS record_count, 2 AS seeds, round(s_acctbal / 10000, 4) AS ratio FROM supplier")
def s09(t: Tables) -> DataFrame:
    """Nested YAML, many sites to a file."""
    folder, key = _folder(t, "sites"), F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("domain: 'host"), key, F.lit(".vc'\nseed_urls:\n- https://a.vc/#x\n- https://b.vc\nlast_success:\n  at: '2026-01-01'\n  record_count: "), key, F.lit("\n  valid_name_ratio: "), F.round(F.col("s_acctbal") / 10000, 4).cast("string"), F.lit("\nnotes: null\n"))
    t.supplier.select(text.alias("value")).write.option("lineSep", "---\n").text(folder)
    rows = files.read_site_files(t.spark, folder)
    return rows.select("domain", "last_success.record_count", F.size("seed_urls").alias("seeds"), F.col("last_success.valid_name_ratio").alias("ratio"))


@plan("S13_csv_sink", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def s13(t: Tables) -> DataFrame:
    folder = _folder(t, "csv")
    for _ in range(2):  # the second takes the first one's place
        files.write_csv(t.part.groupBy("p_brand").agg(F.count("*").alias("n")), folder)
    return t.spark.read.option("header", True).schema("p_brand string, n long").csv(folder)


@plan("S14_parts_with_manifest", "SELECT concat('y', year(o_orderdate)) AS shard, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def s14(t: Tables) -> DataFrame:
    """A part per year, each given twice; the rows are read through the manifest."""
    folder = _folder(t, "parts")
    years = [r["y"] for r in t.orders.select(F.year("o_orderdate").alias("y")).distinct().collect()]
    for y in years + years[:2]:
        sinks.commit_part(t.orders.filter(F.year("o_orderdate") == y), folder, f"y{y}")
    rows = sinks.read_parts(t.spark, folder, "o_orderkey long, o_totalprice double")
    return rows.groupBy("shard").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@plan("S15_atomic_replace", "SELECT s_nationkey, count(*) AS n, count(*) FILTER (WHERE s_suppkey % 2 = 0) AS with_balance FROM supplier GROUP BY 1")
def s15(t: Tables) -> DataFrame:
    """Odd suppliers published without their balance, then even ones with it added by name."""
    folder, odd = _folder(t, "replaced"), F.col("s_suppkey") % 2 == 1
    sinks.publish(t.supplier.filter(odd).select("s_suppkey", "s_nationkey"), folder)
    sinks.replace_by_name(folder, t.supplier.filter(~odd).select("s_nationkey", "s_suppkey", "s_acctbal"))
    return sinks.current(t.spark, folder).groupBy("s_nationkey").agg(F.count("*").alias("n"), F.count("s_acctbal").alias("with_balance"))


@plan("S18_distinct_files", "SELECT 2 * count(*) AS files, count(*) AS distinct_files FROM region")
def s18(t: Tables) -> DataFrame:
    """One file per region, each delivered twice; names of one length are files of one size."""
    folder = _folder(t, "delivered")
    once = t.region.select("r_regionkey", F.rpad("r_name", 40, ".").alias("value")).repartitionByRange(5, "r_regionkey").select("r_regionkey", "value")
    for k in (1, 2):
        once.withColumn("k", F.col("r_regionkey")).select("k", "value").write.partitionBy("k").text(f"{folder}/{k}")
    found = files.distinct_files(t.spark, [f"{folder}/{k}/*/*.txt" for k in (1, 2)])
    return found.agg(F.count("*").alias("files"), F.countDistinct("first").alias("distinct_files"))


@plan("S20_catalog_columns", "SELECT 'orders' AS name, 6 AS columns, true AS has_key, false AS has_other UNION ALL SELECT 'part', 6, false, false")
def s20(t: Tables) -> DataFrame:
    """What a table has is read from its files' footers before a query is put together."""
    found = [(n, len(df.columns), files.has_columns(df, "o_orderkey", "o_custkey"), files.has_columns(df, "o_orderkey", "none")) for n, df in (("orders", t.orders), ("part", t.part))]
    return t.spark.createDataFrame(found, "name string, columns int, has_key boolean, has_other boolean")


@plan("R11_resume", "SELECT round_type, count(*) AS n FROM deals GROUP BY 1", "deals")
def r11_resume(t: Tables) -> DataFrame:
    """A run that stopped after two of its shards is taken up again: only what the manifest lacks is worked on."""
    folder, shards = _folder(t, "resumed"), t.deals.select(F.concat(F.lit("r"), "round_rank").alias("shard"), "round_rank").distinct()
    for stop in (2, None):
        for r in sinks.pending_shards(shards, folder).orderBy("shard").limit(stop or 2**31 - 1).collect():
            sinks.commit_part(t.deals.filter(F.col("round_rank") == r["round_rank"]).select("deal_id", "round_type"), folder, r["shard"])
    return sinks.read_parts(t.spark, folder, "deal_id long, round_type string").groupBy("round_type").agg(F.count("*").alias("n"))
