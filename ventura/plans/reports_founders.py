"""Reports on founders, taxonomy and classifier correction over the firm model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ventura.functions import predicates as P
from ventura.functions import stats as S
from ventura.functions import text as X
from ventura.operators import learning as L
from ventura.operators.similarity import fuzzy_name_match
from ventura.plans.aggregates import AI, BUCKET
from ventura.plans.catalogue import plan
from ventura.plans.model import Tables
from ventura.plans.scalars import FULL_SQL, alike_sql, name_sql, sorted_sql
from ventura.plans.statistics import wilson_sql

_LO, _HI = wilson_sql("ai", "n")
_POSITIONS = f"(SELECT person_id, company_id, {AI} AS is_ai FROM founders JOIN companies ON company_id = id)"
_FLAGS = f"(SELECT person_id, bool_or(is_ai) AS is_ai FROM {_POSITIONS} GROUP BY 1 HAVING bool_or(is_ai) IS NOT NULL)"


def _positions(t: Tables) -> DataFrame:
    return t.founders.join(t.companies, F.col("company_id") == F.col("id")).select("person_id", "company_id", P.is_ai().alias("is_ai"))


def _flags(t: Tables) -> DataFrame:
    """Whether a person founded any flagged firm; persons of whom nothing is known are left out."""
    return _positions(t).groupBy("person_id").agg(F.bool_or("is_ai").alias("is_ai")).filter("is_ai IS NOT NULL")


def _cohort(flag: Column) -> Column:
    return F.when(flag, "AI").otherwise("non-AI")


_COHORT = "CASE WHEN is_ai THEN 'AI' ELSE 'non-AI' END"


@plan("Q14_founder_coverage", f"""
SELECT firms, persons, positions_ai, positions_other, with_demographics, with_degree FROM
  (SELECT count(DISTINCT company_id) AS firms, count(DISTINCT person_id) AS persons, count(*) FILTER (WHERE is_ai) AS positions_ai, count(*) FILTER (WHERE NOT is_ai) AS positions_other FROM {_POSITIONS}),
  (SELECT count(DISTINCT person_id) AS with_demographics FROM people WHERE sex IS NOT NULL), (SELECT count(DISTINCT person_id) AS with_degree FROM degrees WHERE level > 0)""", "companies", "founders", "people", "degrees")
def q14(t: Tables) -> DataFrame:
    """Three one-row results side by side."""
    is_ai = F.col("is_ai")
    own = _positions(t).agg(F.countDistinct("company_id").alias("firms"), F.countDistinct("person_id").alias("persons"), F.count_if(is_ai).alias("positions_ai"), F.count_if(~is_ai).alias("positions_other"))
    known = t.people.filter("sex IS NOT NULL").agg(F.countDistinct("person_id").alias("with_demographics"))
    taught = t.degrees.filter("level > 0").agg(F.countDistinct("person_id").alias("with_degree"))
    one = lambda df: df.withColumn("one", F.lit(1))
    return one(own).join(F.broadcast(one(known)), "one").join(F.broadcast(one(taught)), "one").drop("one")


@plan("Q15_founder_gender", f"SELECT {_COHORT} AS cohort, count(*) AS founders, round(100.0 * count(*) FILTER (WHERE sex = 'F') / count(*), 4)::DOUBLE AS pct_female, round(avg(prestige), 6) AS prestige_mean, round(median(prestige), 6) AS prestige_median FROM people JOIN {_FLAGS} USING (person_id) GROUP BY 1", "companies", "founders", "people")
def q15(t: Tables) -> DataFrame:
    """Persons of unknown sex count in the denominator."""
    rows = t.people.join(_flags(t), "person_id").groupBy(_cohort(F.col("is_ai")).alias("cohort"))
    made = rows.agg(F.count("*").alias("founders"), F.count_if(F.col("sex") == "F").alias("f"), F.round(F.avg("prestige"), 6).alias("prestige_mean"), F.round(F.median("prestige"), 6).alias("prestige_median"))
    return made.select("cohort", "founders", S.pct(F.col("f"), F.col("founders"), 4).alias("pct_female"), "prestige_mean", "prestige_median")


_HIGHEST = "(SELECT person_id, max(level) AS level FROM degrees GROUP BY 1)"


def _highest(t: Tables) -> DataFrame:
    return t.degrees.groupBy("person_id").agg(F.max("level").alias("level"))


def _within(df: DataFrame, key: str) -> DataFrame:
    """Counts by cohort and ``key`` with the share of the cohort; the window sees aggregated cells alone."""
    cells = df.groupBy(_cohort(F.col("is_ai")).alias("cohort"), key).agg(F.count("*").alias("n"))
    return cells.withColumn("pct", S.pct(F.col("n"), F.sum("n").over(Window.partitionBy("cohort")), 4))


def _within_sql(source: str, key: str) -> str:
    return f"SELECT cohort, {key}, n, round(100.0 * n / sum(n) OVER (PARTITION BY cohort), 4)::DOUBLE AS pct FROM (SELECT {_COHORT} AS cohort, {key}, count(*) AS n FROM {source} GROUP BY 1, 2)"


@plan("Q16_founder_degree", _within_sql(f"{_HIGHEST} JOIN {_FLAGS} USING (person_id)", "level"), "companies", "founders", "degrees")
def q16(t: Tables) -> DataFrame:
    return _within(_highest(t).join(_flags(t), "person_id"), "level")


@plan("Q17_founder_field", f"SELECT * FROM ({_within_sql(f'degrees JOIN {_FLAGS} USING (person_id)', 'subject')}) WHERE subject IN (SELECT subject FROM degrees JOIN {_FLAGS} USING (person_id) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 15)", "companies", "founders", "degrees")
def q17(t: Tables) -> DataFrame:
    """Shares over all fields, of which the fifteen commonest are shown."""
    cells = _within(t.degrees.join(_flags(t), "person_id"), "subject")
    top = cells.groupBy("subject").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "subject").limit(15).select("subject")
    return cells.join(F.broadcast(top), "subject", "left_semi")


_TOP_25 = "SELECT institution, count(*) AS {0} FROM degrees JOIN {1} USING (person_id) WHERE {2} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25"


@plan("Q18_founder_universities", f"SELECT institution, coalesce(all_founders, 0) AS all_founders, coalesce(ai_founders, 0) AS ai_founders FROM ({_TOP_25.format('all_founders', _FLAGS, 'true')}) FULL JOIN ({_TOP_25.format('ai_founders', _FLAGS, 'is_ai')}) USING (institution)", "companies", "founders", "degrees")
def q18(t: Tables) -> DataFrame:
    """Two lists of 25, joined by name; a name that is on one list alone has 0 on the other."""
    counts = t.degrees.join(_flags(t), "person_id").groupBy("institution").agg(F.count("*").alias("all_founders"), F.count_if("is_ai").alias("ai_founders"))
    best = lambda c: counts.filter(F.col(c) > 0).orderBy(F.desc(c), "institution").limit(25).select("institution", c)
    return best("all_founders").join(best("ai_founders"), "institution", "full").select("institution", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("all_founders", "ai_founders")))


@plan("Q20_application_by_bucket", f"SELECT bucket, segment, n, round(100.0 * n / sum(n) OVER (PARTITION BY bucket), 4)::DOUBLE AS share FROM (SELECT {BUCKET} AS bucket, segment, count(*) AS n FROM companies WHERE {AI} GROUP BY 1, 2)", "companies")
def q20(t: Tables) -> DataFrame:
    cells = t.companies.filter(P.is_ai()).groupBy(P.coverage_bucket().alias("bucket"), "segment").agg(F.count("*").alias("n"))
    return cells.withColumn("share", S.pct(F.col("n"), F.sum("n").over(Window.partitionBy("bucket")), 4))


@plan("Q42_transition_matrix", f"SELECT first, second, third, n, round(100.0 * n / sum(n) OVER (), 4)::DOUBLE AS pct FROM (SELECT cb_ai_tagged AS first, ai_mentioned AS second, {AI} AS third, count(*) AS n FROM companies GROUP BY 1, 2, 3)", "companies")
def q42(t: Tables) -> DataFrame:
    """Three readings of one firm; the window sees at most 27 cells."""
    cells = t.companies.groupBy(F.col("cb_ai_tagged").alias("first"), F.col("ai_mentioned").alias("second"), P.is_ai().alias("third")).agg(F.count("*").alias("n"))
    return cells.withColumn("pct", S.pct(F.col("n"), F.sum("n").over(Window.partitionBy()), 4))


@plan("Q44_founder_education", f"SELECT {_COHORT} AS cohort, count(*) AS with_degree, round(100.0 * count(*) FILTER (WHERE level = 3) / count(*), 4)::DOUBLE AS pct_phd, round(100.0 * count(*) FILTER (WHERE level = 2) / count(*), 4)::DOUBLE AS pct_masters, round(100.0 * count(*) FILTER (WHERE level = 1) / count(*), 4)::DOUBLE AS pct_bachelor FROM (SELECT DISTINCT person_id, is_ai FROM {_POSITIONS} WHERE is_ai IS NOT NULL) JOIN {_HIGHEST} USING (person_id) WHERE level > 0 GROUP BY 1", "companies", "founders", "degrees")
def q44(t: Tables) -> DataFrame:
    """A person with firms of both kinds is in both cohorts, unlike in Q15 to Q18."""
    rows = _positions(t).filter("is_ai IS NOT NULL").select("person_id", "is_ai").distinct().join(_highest(t).filter("level > 0"), "person_id")
    cells = rows.groupBy(_cohort(F.col("is_ai")).alias("cohort")).agg(F.count("*").alias("with_degree"), *(F.count_if(F.col("level") == k).alias(f"l{k}") for k in (1, 2, 3)))
    return cells.select("cohort", "with_degree", *(S.pct(F.col(f"l{k}"), F.col("with_degree"), 4).alias(name) for k, name in ((3, "pct_phd"), (2, "pct_masters"), (1, "pct_bachelor"))))


_AI_PERSONS = f"(SELECT DISTINCT person_id FROM {_POSITIONS} WHERE is_ai)"


def _top_20(t: Tables, column: str) -> DataFrame:
    """The twenty commonest values over flagged firms' founders are the feature."""
    persons = _positions(t).filter("is_ai").select("person_id")
    rows = t.degrees.join(persons, "person_id", "left_semi").select(F.trim(column).alias(column)).filter(F.col(column) != "")
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(20)


def _top_20_sql(column: str) -> str:
    return f"SELECT trim({column}) AS {column}, count(*) AS n FROM degrees JOIN {_AI_PERSONS} USING (person_id) WHERE trim({column}) <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"


@plan("Q45_founder_fields", _top_20_sql("subject"), "companies", "founders", "degrees")
def q45(t: Tables) -> DataFrame:
    return _top_20(t, "subject")


@plan("Q46_founder_institutions", _top_20_sql("institution"), "companies", "founders", "degrees")
def q46(t: Tables) -> DataFrame:
    return _top_20(t, "institution")


_TILT = f"SELECT tag, count(*) AS n, count(*) FILTER (WHERE {BUCKET} = 'Unlisted') AS hidden FROM firm_tags JOIN companies ON company_id = id WHERE {AI} GROUP BY 1"


def _tag_cells(t: Tables) -> DataFrame:
    rows = t.firm_tags.join(t.companies, F.col("company_id") == F.col("id")).filter(P.is_ai())
    return rows.groupBy("tag").agg(F.count("*").alias("n"), F.count_if(P.coverage_bucket() == "Unlisted").alias("hidden"))


@plan("Q47_taxonomy_tilt", f"SELECT tag, n, round((hidden::DOUBLE / sum(hidden) OVER ()) / ((n - hidden)::DOUBLE / sum(n - hidden) OVER ()), 8) AS tilt FROM ({_TILT}) WHERE n > hidden", "companies", "firm_tags")
def q47(t: Tables) -> DataFrame:
    """A tag's share of hidden firms over its share of listed ones, over tags that listed firms bear."""
    whole = Window.partitionBy()
    listed = F.col("n") - F.col("hidden")
    share = lambda c: c.cast("double") / F.sum(c).over(whole)
    return _tag_cells(t).filter("n > hidden").select("tag", "n", F.round(share(F.col("hidden")) / share(listed), 8).alias("tilt"))


@plan("Q49_domain_tilt", f"SELECT tag AS domain, n, round(100.0 * hidden / n, 1)::DOUBLE AS hidden_pct FROM ({_TILT})", "companies", "firm_tags")
def q49(t: Tables) -> DataFrame:
    return _tag_cells(t).select(F.col("tag").alias("domain"), "n", S.pct(F.col("hidden"), F.col("n"), 1).alias("hidden_pct"))


@plan("K08_corrected_gap")
def k08(t: Tables) -> DataFrame:
    """Gap of unlisted firms to each database after correction, from 20,000 draws of a few rows: median, interval, P(gap > 0)."""
    said, true = F.col("ai_score") >= 0.5, F.col("llm_ai_verified")
    cells = t.companies.groupBy(P.coverage_bucket().alias("bucket")).agg(
        F.count("ai_score").alias("n"), F.count_if(said).alias("ai"), F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"), F.count_if(~said & ~true).alias("tn")
    )
    drawn = L.corrected_draws(cells, "bucket", 20_000, 8).filter("share IS NOT NULL")
    own = drawn.filter("bucket = 'Unlisted'").select("draw", F.col("share").alias("own"))
    gaps = drawn.filter("bucket <> 'Unlisted'").join(own, "draw").withColumn("gap", 100 * (F.col("own") - F.col("share")))
    made = gaps.groupBy("bucket").agg(F.percentile("gap", F.array(*map(F.lit, (0.025, 0.5, 0.975)))).alias("p"), F.avg((F.col("gap") > 0).cast("double")).alias("above"))
    return made.select("bucket", *(F.round(F.col("p")[k], 2).alias(name) for k, name in enumerate(("lo", "gap", "hi"))), F.round("above", 4).alias("p_gap_gt_0"))


@plan("K09_reference_labels", f"""
SELECT bucket, n, ai, round(100.0 * ai / n, 4)::DOUBLE AS ai_pct, round(100 * {_LO}, 6) AS lo, round(100 * {_HI}, 6) AS hi,
  CASE WHEN bucket <> 'Unlisted' THEN round((un_ai::DOUBLE / un_n - ai::DOUBLE / n) / sqrt(((un_ai + ai)::DOUBLE / (un_n + n)) * (1 - (un_ai + ai)::DOUBLE / (un_n + n)) * (1.0 / un_n + 1.0 / n)), 8) END AS z
FROM (SELECT *, max(ai) FILTER (WHERE bucket = 'Unlisted') OVER () AS un_ai, max(n) FILTER (WHERE bucket = 'Unlisted') OVER () AS un_n FROM
  (SELECT {BUCKET} AS bucket, count(*) AS n, count(*) FILTER (WHERE llm_ai_verified) AS ai FROM companies WHERE llm_ai_verified IS NOT NULL GROUP BY 1))""", "companies")
def k09(t: Tables) -> DataFrame:
    """Prevalence by reference labels alone, with z of unlisted firms against each database."""
    cells = t.companies.filter("llm_ai_verified IS NOT NULL").groupBy(P.coverage_bucket().alias("bucket")).agg(F.count("*").alias("n"), F.count_if("llm_ai_verified").alias("ai"))
    own = lambda c: F.max(F.when(F.col("bucket") == "Unlisted", F.col(c))).over(Window.partitionBy())
    cells = cells.withColumn("un_ai", own("ai")).withColumn("un_n", own("n"))
    lo, hi = S.wilson(F.col("ai"), F.col("n"))
    z, _ = S.two_proportion_p(F.col("un_ai"), F.col("un_n"), F.col("ai"), F.col("n"))
    return cells.select("bucket", "n", "ai", S.pct(F.col("ai"), F.col("n"), 4).alias("ai_pct"), F.round(100 * lo, 6).alias("lo"), F.round(100 * hi, 6).alias("hi"), F.when(F.col("bucket") != "Unlisted", F.round(z, 8)).alias("z"))


_RAW = "CASE id % 4 WHEN 0 THEN concat(name, ' AI') WHEN 1 THEN concat(name, ', Inc.') WHEN 2 THEN concat(name, ' Labs') ELSE upper(name) END"
_MARK = r"(^|[^a-z0-9])ai([^a-z0-9]|$)"


def _variants(t: Tables) -> DataFrame:
    """A firm's name beside the name a signal gave it, where they differ but for case and blanks."""
    rows = t.companies.select("id", "name", F.expr(_RAW).alias("raw_name"))
    rows = rows.filter(F.lower(F.trim("raw_name")) != F.lower(F.trim("name")))
    mark = lambda c: F.lower(c).rlike(_MARK)
    same = X.normalize_company_name(F.col("raw_name")).eqNullSafe(X.normalize_company_name(F.col("name")))
    return rows.select("id", "name", "raw_name", same.alias("exact_after_norm"), (mark("raw_name") != mark("name")).alias("marker_asymmetry"))


@plan("K52_name_variant_pairs", f"""
SELECT id, name, raw_name, x IS NOT DISTINCT FROM y AS exact_after_norm, regexp_matches(lower(raw_name), '{_MARK}') <> regexp_matches(lower(name), '{_MARK}') AS marker_asymmetry,
  round(CASE WHEN sx IS NULL OR sy IS NULL THEN 0.0 ELSE {alike_sql('sx', 'sy')} END, 6) AS similarity
FROM (SELECT *, {sorted_sql('x')} AS sx, {sorted_sql('y')} AS sy FROM (SELECT id, name, raw_name, {name_sql('raw_name', FULL_SQL)} AS x, {name_sql('name', FULL_SQL)} AS y
  FROM (SELECT id, name, {_RAW} AS raw_name FROM companies) WHERE lower(trim(raw_name)) <> lower(trim(name))))""", "companies")
def k52(t: Tables) -> DataFrame:
    return _variants(t).withColumn("similarity", F.round(fuzzy_name_match(F.col("raw_name"), F.col("name")), 6))
