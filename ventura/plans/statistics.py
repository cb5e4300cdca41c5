"""Statistics and learning over the firm model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ventura.functions import predicates as P
from ventura.functions import stats as S
from ventura.operators import clustering as C
from ventura.operators import learning as L
from ventura.operators.joins import top_per_key
from ventura.plans.aggregates import AI, BUCKET, YEAR
from ventura.plans.catalogue import plan
from ventura.plans.model import Tables
from ventura.plans.windows import spearman

Z2 = S.Z * S.Z


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    p = f"({k}::DOUBLE / nullif({n}, 0))"
    centre = f"({p} + {Z2} / (2 * {n})) / (1 + {Z2} / {n})"
    half = f"{S.Z} * sqrt({p} * (1 - {p}) / {n} + {Z2} / (4.0 * {n} * {n})) / (1 + {Z2} / {n})"
    return f"({centre} - {half})", f"({centre} + {half})"


_LO, _HI = wilson_sql("ai", "n")
_BY_BUCKET = f"SELECT {BUCKET} AS bucket, count(*) AS n, count(*) FILTER (WHERE {AI}) AS ai FROM companies GROUP BY 1"


def by_bucket(t: Tables) -> DataFrame:
    return t.companies.groupBy(P.coverage_bucket().alias("bucket")).agg(F.count("*").alias("n"), F.count_if(P.is_ai()).alias("ai"))


@plan("M01_wilson", f"SELECT bucket, n, ai, round(100 * {_LO}, 6) AS lo, round(100 * {_HI}, 6) AS hi FROM ({_BY_BUCKET})", "companies")
def m01(t: Tables) -> DataFrame:
    lo, hi = S.wilson(F.col("ai"), F.col("n"))
    return by_bucket(t).select("bucket", "n", "ai", F.round(100 * lo, 6).alias("lo"), F.round(100 * hi, 6).alias("hi"))


def gaps(t: Tables) -> DataFrame:
    """The unlisted bucket beside each of the others, one row each."""
    rows = by_bucket(t)
    rest = rows.filter("bucket = 'Unlisted'").select(F.col("n").alias("n1"), F.col("ai").alias("k1"), F.lit(1).alias("one"))
    return rows.filter("bucket <> 'Unlisted'").withColumn("one", F.lit(1)).join(rest, "one").select("bucket", "n1", "k1", F.col("n").alias("n2"), F.col("ai").alias("k2"))


_GAPS = f"SELECT b.bucket, a.n AS n1, a.ai AS k1, b.n AS n2, b.ai AS k2 FROM ({_BY_BUCKET}) a, ({_BY_BUCKET}) b WHERE a.bucket = 'Unlisted' AND b.bucket <> 'Unlisted'"
_L1, _U1 = wilson_sql("k1", "n1")
_L2, _U2 = wilson_sql("k2", "n2")
_P1, _P2 = "(k1::DOUBLE / n1)", "(k2::DOUBLE / n2)"


@plan("M02_newcombe", f"""
SELECT bucket, round({_P1} - {_P2}, 9) AS d, round({_P1} - {_P2} - sqrt(({_P1} - {_L1}) * ({_P1} - {_L1}) + ({_U2} - {_P2}) * ({_U2} - {_P2})), 9) AS lo, round({_P1} - {_P2} + sqrt(({_U1} - {_P1}) * ({_U1} - {_P1}) + ({_P2} - {_L2}) * ({_P2} - {_L2})), 9) AS hi FROM ({_GAPS})""", "companies")
def m02(t: Tables) -> DataFrame:
    d, lo, hi = S.newcombe(F.col("k1"), F.col("n1"), F.col("k2"), F.col("n2"))
    return gaps(t).select("bucket", F.round(d, 9).alias("d"), F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"))


@plan("M03_odds_ratio", f"""
SELECT bucket, round(r, 8) AS ratio, round(exp(ln(r) - {S.Z} * e), 8) AS lo, round(exp(ln(r) + {S.Z} * e), 8) AS hi FROM (
  SELECT bucket, (k1::DOUBLE * (n2 - k2)) / ((n1 - k1)::DOUBLE * k2) AS r, sqrt(1.0 / k1 + 1.0 / (n1 - k1) + 1.0 / k2 + 1.0 / (n2 - k2)) AS e FROM ({_GAPS}))""", "companies")  # fmt: skip
def m03(t: Tables) -> DataFrame:
    ratio, lo, hi = S.odds_ratio(F.col("k1"), F.col("n1"), F.col("k2"), F.col("n2"))
    return gaps(t).select("bucket", F.round(ratio, 8).alias("ratio"), F.round(lo, 8).alias("lo"), F.round(hi, 8).alias("hi"))


@plan("M04_leave_one_out", f"""
SELECT segment, sum(n) OVER () - n AS n, sum(ai) OVER () - ai AS ai, 100.0 * (sum(ai) OVER () - ai) / (sum(n) OVER () - n) AS share FROM (SELECT segment, count(*) AS n, count(*) FILTER (WHERE {AI}) AS ai FROM companies GROUP BY 1)
UNION ALL SELECT '(none)', count(*), count(*) FILTER (WHERE {AI}), 100.0 * count(*) FILTER (WHERE {AI}) / count(*) FROM companies""", "companies")  # fmt: skip
def m04(t: Tables) -> DataFrame:
    rows = t.companies.groupBy("segment").agg(F.count("*").alias("n"), F.count_if(P.is_ai()).alias("ai"))
    every = Window.partitionBy()
    left = rows.select("segment", (F.sum("n").over(every) - F.col("n")).alias("n"), (F.sum("ai").over(every) - F.col("ai")).alias("ai"))
    whole = rows.agg(F.lit("(none)").alias("segment"), F.sum("n").alias("n"), F.sum("ai").alias("ai"))
    return left.unionByName(whole).withColumn("share", 100 * F.col("ai").cast("double") / F.col("n"))


@plan("M06_location_quotient", f"""
SELECT country, tag, ai, (ai::DOUBLE / cn) / (tn::DOUBLE / alln) AS lq FROM (SELECT country, tag, count(*) AS ai, sum(count(*)) OVER (PARTITION BY country) AS cn, sum(count(*)) OVER (PARTITION BY tag) AS tn, sum(count(*)) OVER () AS alln
  FROM firm_tags JOIN companies ON company_id = id WHERE {AI} GROUP BY 1, 2) WHERE ai >= 5""", "companies", "firm_tags")  # fmt: skip
def m06(t: Tables) -> DataFrame:
    rows = t.firm_tags.join(t.companies.filter(P.is_ai()), F.col("company_id") == F.col("id")).groupBy("country", "tag").agg(F.count("*").alias("ai"))
    # totals are over all rows; the floor comes after
    total = lambda *keys: F.sum("ai").over(Window.partitionBy(*keys)).cast("double")
    rows = rows.withColumn("lq", (F.col("ai") / total("country")) / (total("tag") / total()))
    return rows.filter("ai >= 5")


@plan("M07_early_late", f"""
SELECT country, 100.0 * e_ai / nullif(e, 0) AS early, 100.0 * l_ai / nullif(l, 0) AS late, 100.0 * l_ai / nullif(l, 0) - 100.0 * e_ai / nullif(e, 0) AS change FROM (SELECT country, count(*) FILTER (WHERE {YEAR} BETWEEN 2010 AND 2016) AS e, count(*) FILTER (WHERE {YEAR} BETWEEN 2010 AND 2016 AND {AI}) AS e_ai,
  count(*) FILTER (WHERE {YEAR} BETWEEN 2018 AND 2025) AS l, count(*) FILTER (WHERE {YEAR} BETWEEN 2018 AND 2025 AND {AI}) AS l_ai FROM companies GROUP BY 1)""", "companies")  # fmt: skip
def m07(t: Tables) -> DataFrame:
    y, ai = P.effective_year(), P.is_ai()
    share = lambda a, b: F.try_divide(100 * F.count_if(y.between(a, b) & ai).cast("double"), F.count_if(y.between(a, b)).cast("double"))
    return t.companies.groupBy("country").agg(share(2010, 2016).alias("early"), share(2018, 2025).alias("late")).withColumn("change", F.col("late") - F.col("early"))


@plan("M08_cohort_growth", """
SELECT deal_year, share, (share / nullif(lag(share) OVER (ORDER BY deal_year), 0) - 1) * 100 AS growth FROM (SELECT deal_year, count(*) FILTER (WHERE status = 'F')::DOUBLE / count(*) AS share FROM deals GROUP BY 1)""", "deals")
def m08(t: Tables) -> DataFrame:
    rows = t.deals.groupBy("deal_year").agg((F.count_if(F.col("status") == "F").cast("double") / F.count("*")).alias("share"))
    return rows.withColumn("growth", (F.try_divide(F.col("share"), F.lag("share").over(Window.orderBy("deal_year"))) - 1) * 100)


@plan("M09_recent_growth", """
SELECT event_type, new, old, CASE WHEN old = 0 AND new > 0 THEN 100.0 WHEN old = 0 THEN 0.0 ELSE 100.0 * (new - old) / old END AS growth FROM (SELECT event_type, count(*) FILTER (WHERE ts > m - INTERVAL 10 DAY) AS new, count(*) FILTER (WHERE ts > m - INTERVAL 20 DAY AND ts <= m - INTERVAL 10 DAY) AS old
  FROM events, (SELECT max(ts) AS m FROM events) GROUP BY 1)""")  # fmt: skip
def m09(t: Tables) -> DataFrame:
    e = t.events
    latest = e.agg(F.max("ts").alias("m"))
    age = F.col("m") - F.col("ts")
    rows = e.withColumn("one", F.lit(1)).join(F.broadcast(latest.withColumn("one", F.lit(1))), "one")
    ten, twenty = F.expr("INTERVAL '10' DAY"), F.expr("INTERVAL '20' DAY")
    rows = rows.groupBy("event_type").agg(F.count_if(age < ten).alias("new"), F.count_if((age >= ten) & (age < twenty)).alias("old"))
    return rows.withColumn("growth", F.when((F.col("old") == 0) & (F.col("new") > 0), 100.0).when(F.col("old") == 0, 0.0).otherwise(100 * (F.col("new") - F.col("old")).cast("double") / F.col("old")))


@plan("M10_rogan_gladen", f"SELECT bucket, round(greatest(0, least(1, (ai::DOUBLE / n + 0.906 - 1) / (0.789 + 0.906 - 1))), 9) AS corrected FROM ({_BY_BUCKET})", "companies")
def m10(t: Tables) -> DataFrame:
    return by_bucket(t).select("bucket", F.round(S.rogan_gladen(F.col("ai") / F.col("n"), F.lit(0.789), F.lit(0.906)), 9).alias("corrected"))


@plan("M11_parametric_bootstrap")
def m11(t: Tables) -> DataFrame:
    return L.beta_bootstrap(by_bucket(t), "bucket", "ai", "n", 20_000, 11)


@plan("M12_bootstrap_f1")
def m12(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id").select("doc_id", (F.col("quality") == 1).alias("y"), (F.length("text") >= 600).alias("p"))
    return L.bootstrap_f1(rows, 2000, 7)


@plan("M13_two_proportions", f"SELECT bucket, round(z, 8) AS z FROM (SELECT bucket, ({_P1} - {_P2}) / sqrt(((k1 + k2)::DOUBLE / (n1 + n2)) * (1 - (k1 + k2)::DOUBLE / (n1 + n2)) * (1.0 / n1 + 1.0 / n2)) AS z FROM ({_GAPS}))", "companies")
def m13(t: Tables) -> DataFrame:
    z, _ = S.two_proportion_p(F.col("k1"), F.col("n1"), F.col("k2"), F.col("n2"))
    return gaps(t).select("bucket", F.round(z, 8).alias("z"))


@plan("M14_pearson_fisher", """
SELECT round(r, 8) AS r, round(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)), 8) AS lo, round(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)), 8) AS hi FROM (SELECT corr(n_deals, total) AS r, count(*) AS n FROM (SELECT company_id, count(*) AS n_deals, sum(deal_size) AS total FROM deals GROUP BY 1))""", "deals")
def m14(t: Tables) -> DataFrame:
    rows = t.deals.groupBy("company_id").agg(F.count("*").alias("n_deals"), F.sum("deal_size").alias("total")).agg(F.corr("n_deals", "total").alias("r"), F.count("*").alias("n"))
    half = S.Z / F.sqrt(F.col("n") - 3)
    return rows.select(F.round("r", 8).alias("r"), F.round(F.tanh(F.atanh("r") - half), 8).alias("lo"), F.round(F.tanh(F.atanh("r") + half), 8).alias("hi"))


@plan("M15_divergences", """
SELECT round(0.5 * sum(abs(p - q)), 9) AS tv, round(0.5 * sum(CASE WHEN p > 0 THEN p * ln(p / m) ELSE 0 END) + 0.5 * sum(CASE WHEN q > 0 THEN q * ln(q / m) ELSE 0 END), 9) AS jsd FROM (
  SELECT coalesce(a.s, 0) AS p, coalesce(b.s, 0) AS q, (coalesce(a.s, 0) + coalesce(b.s, 0)) / 2 AS m FROM (SELECT segment, count(*)::DOUBLE / sum(count(*)) OVER () AS s FROM companies WHERE region = 'ASIA' GROUP BY 1) a FULL JOIN (SELECT segment, count(*)::DOUBLE / sum(count(*)) OVER () AS s FROM companies WHERE region = 'EUROPE' GROUP BY 1) b ON a.segment = b.segment)""", "companies")  # fmt: skip
def m15(t: Tables) -> DataFrame:
    share = lambda region, name: t.companies.filter(F.col("region") == region).groupBy("segment").agg(F.count("*").alias("k")).select("segment", (F.col("k").cast("double") / F.sum("k").over(Window.partitionBy())).alias(name))
    rows = share("ASIA", "p").join(share("EUROPE", "q"), "segment", "full").na.fill(0.0)
    m = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.sum(F.when(x > 0, x * F.log(x / m)).otherwise(0.0))
    return rows.agg(F.round(0.5 * F.sum(F.abs(F.col("p") - F.col("q"))), 9).alias("tv"), F.round(0.5 * part(F.col("p")) + 0.5 * part(F.col("q")), 9).alias("jsd"))


@plan("M16_fill_accuracy", "SELECT region, count(founded_year)::DOUBLE / count(*) AS fill, count(*) FILTER (WHERE abs(founded_year - cohort_year) <= 2)::DOUBLE / nullif(count(founded_year + cohort_year), 0) AS within_2 FROM companies GROUP BY 1", "companies")
def m16(t: Tables) -> DataFrame:
    a, b = F.col("founded_year"), F.col("cohort_year")
    return t.companies.groupBy("region").agg((F.count(a) / F.count("*")).alias("fill"), F.try_divide(F.count_if(F.abs(a - b) <= 2).cast("double"), F.count(a + b).cast("double")).alias("within_2"))


@plan("M17_first_true", "SELECT site, min(finished_at) FILTER (WHERE status = 'error' AND seconds > 80) AS first_bad, CASE WHEN count(*) FILTER (WHERE status = 'error' AND seconds > 80) = 0 THEN 'never' ELSE 'found' END AS code FROM runs GROUP BY 1", "runs")
def m17(t: Tables) -> DataFrame:
    hit = (F.col("status") == "error") & (F.col("seconds") > 80)
    return t.runs.groupBy("site").agg(F.min(F.when(hit, F.col("finished_at"))).alias("first_bad"), F.when(F.count_if(hit) == 0, "never").otherwise("found").alias("code"))


@plan("M18_text_clusters")
def m18(t: Tables) -> DataFrame:
    """All documents in 50 clusters."""
    return C.text_clusters(t.documents, 50).select(F.col("id").alias("doc_id"), "cluster")


@plan("M19_vector_clusters")
def m19(t: Tables) -> DataFrame:
    """All vectors in 150 clusters, each with the label that most of its members have (ties: the smallest)."""
    vectors = C.dense_vectors(t.embeddings, "vec_id", "embedding")
    dims = t.embeddings.agg(F.max(F.size("embedding"))).first()[0] or 0
    found = C.assign(vectors, C.minibatch_kmeans(vectors, 150, dims, batch=4096)).withColumnRenamed("id", "vec_id")
    met = found.join(t.embeddings.select("vec_id", "label"), "vec_id")
    named = met.groupBy("cluster", "label").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("cluster_label"))
    return met.select("vec_id", "cluster").join(named, "cluster")


@plan("M20_distinctive_terms", r"""
, k AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]{2,}'), lambda w: NOT list_contains(__STOP__, w)) AS w FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM k),
c AS (SELECT doc_id, term, count(*) AS tf FROM u GROUP BY 1, 2), n AS (SELECT count(DISTINCT doc_id) AS n FROM documents),
v AS (SELECT term, df, n FROM (SELECT term, count(*) AS df, sum(tf) AS total FROM c GROUP BY 1), n WHERE df >= 8 AND df <= 0.35 * n ORDER BY total DESC, term LIMIT 8000),
x AS (SELECT doc_id, term, (1 + ln(tf)) * (1 + ln((1 + n)::DOUBLE / (1 + df))) AS w FROM c JOIN v USING (term)),
y AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM x),
g AS (SELECT lang, count(*) AS docs FROM documents GROUP BY 1),
m AS (SELECT lang, term, sum(w) / any_value(docs) AS mean FROM y JOIN documents USING (doc_id) JOIN g USING (lang) GROUP BY 1, 2)
SELECT lang, term, round(mean, 9) AS mean FROM m QUALIFY row_number() OVER (PARTITION BY lang ORDER BY round(mean, 9) DESC, term) <= 10""".replace(", k AS", "WITH k AS", 1).replace("__STOP__", "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in C.STOP) + "]"))  # fmt: skip
def m20(t: Tables) -> DataFrame:
    """The ten terms of the largest mean TF-IDF in each language, a language standing for a cluster."""
    weights = C.tf_idf(t.documents, carried=("lang",)).filter("doc_id IS NOT NULL")
    weights = weights.select(F.explode("lang").alias("lang"), "term", "weight").groupBy("lang", "term").agg(F.sum("weight").alias("total"))
    sizes = t.documents.groupBy("lang").agg(F.count("*").alias("docs"))
    means = weights.join(F.broadcast(sizes), "lang").select("lang", "term", F.round(F.col("total") / F.col("docs"), 9).alias("mean"))
    return top_per_key(means, ["lang"], [F.desc("mean"), F.col("term")], 10)


@plan("M23_triangulation", "SELECT company_id, late > early AS grew, (late > early) AND bool_flag AS both FROM (SELECT company_id, sum(deal_size) FILTER (WHERE deal_year >= 1999) AS late, sum(deal_size) FILTER (WHERE deal_year < 1997) AS early, bool_or(round_rank = 0) AS bool_flag FROM deals GROUP BY 1)", "deals")
def m23(t: Tables) -> DataFrame:
    total = lambda test: F.sum(F.when(test, F.col("deal_size")))
    rows = t.deals.groupBy("company_id").agg(total(F.col("deal_year") >= 1999).alias("late"), total(F.col("deal_year") < 1997).alias("early"), F.bool_or(F.col("round_rank") == 0).alias("f"))
    grew = F.col("late") > F.col("early")
    return rows.select("company_id", grew.alias("grew"), (grew & F.col("f")).alias("both"))


@plan("M24_exit_outcomes", f"SELECT {BUCKET} AS bucket, {AI} AS is_ai, count(*) AS n, count(*) FILTER (WHERE operating_status = 'acquired') AS acquired, count(*) FILTER (WHERE operating_status = 'ipo') AS ipo FROM companies GROUP BY 1, 2", "companies")
def m24(t: Tables) -> DataFrame:
    is_status = lambda s: F.count_if(F.col("operating_status") == s)
    return t.companies.groupBy(P.coverage_bucket().alias("bucket"), P.is_ai().alias("is_ai")).agg(F.count("*").alias("n"), is_status("acquired").alias("acquired"), is_status("ipo").alias("ipo"))
