"""Fields and places of imported firms, masking and the taxonomy's last step: stated cases and brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ventura.functions import firm_fields as FF
from ventura.functions import gazetteer as G
from ventura.functions import masking as K
from ventura.functions import rules as R
from ventura.operators.taxonomy import PENDING, learned_combinations, promote_pending


def values(spark, made, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", made(F.col("t")).alias("v")).collect()
    return [r["v"] for r in sorted(rows, key=lambda r: r["k"])]


def test_clean_country(spark):
    want = {"USA": "United States", " gbr ": "United Kingdom", "England": "United Kingdom", "CZE": "Czechia", "Czechia": "Czech Republic", "Earth": None, "TX": None, "": None, None: None}
    assert values(spark, G.clean_country, list(want)) == list(want.values())


def test_locations(spark):
    want = {
        "San Francisco, CA": ("US", "San Francisco"), "London, United Kingdom": ("GB", "London"), "Berlin, Germany": ("DE", "Berlin"), "Singapore": ("SG", None), "Fresno, C.A.": ("US", "Fresno"),
        "Lyon, Gondor": ("Gondor", "Lyon"), "x, 1a": ("1A", "x"), "Vianden, Luxembourg": ("Luxembourg", "Vianden"), "Remote": (None, "Remote"), "nan": (None, "nan"), "A,,": ("", "A"),
    }
    assert [tuple(v) for v in values(spark, G.location_of, list(want))] == list(want.values())
    deal = {"Paris, France": ("FR", "Paris"), "San Francisco, CA": ("CA", "San Francisco"), "Vianden, Luxembourg": ("LU", "Vianden"), "x, 1a": ("1a", "x"), "Oman": ("OM", None)}
    assert [tuple(v) for v in values(spark, G.deal_location_of, list(deal))] == list(deal.values())
    assert values(spark, G.location_of, ["", None]) == [None, None]
    assert values(spark, G.deal_location_of, ["", "NaN", "none", None]) == [None] * 4


def test_profile_countries(spark):
    want = {
        "united  states": ("United States", 0.95), "San Francisco, CA": ("United States", 0.85), "Berlin, DE": ("Germany", 0.85), "Köln · Remote": ("Germany", 0.85), "greater new york area": ("United States", 0.75),
        "Tel Aviv-Yafo": ("Israel", 0.75), "Fresno, CA": ("United States", 0.8), "Anytown, DC": ("United States", 0.8), "somewhere, Korea": ("South Korea", 0.9), "somewhere, Kenya": (None, 0.0), "parishes": (None, 0.0), "Earth": (None, 0.0), "": (None, 0.0), None: (None, 0.0),
        "lyonnais, paris_x": (None, 0.0), "Cambridge, MA area": ("United States", 0.75),
    }
    assert [tuple(v) for v in values(spark, G.country_of, list(want))] == list(want.values())


def test_profile_steps_are_computed_once(spark):
    rows = spark.createDataFrame([("Berlin",)], "t string").withColumn("at", G.country_of(F.col("t"))).select("at.country", "at.confidence")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"(?U)\b") == 1  # the edges of a text's words, not once for each city and answer


def test_positions(spark):
    rows = [("Germany", "Berlin"), ("Germany", "nowhere"), ("germany", "BERLIN"), ("UK", "paris"), (None, "sf"), ("x", None), (None, None)]
    made = spark.createDataFrame(rows, "land string, city string").select(G.position_of(F.col("land"), F.col("city")).alias("v")).collect()
    at = G.POSITIONS
    # a country as written goes before a city in another case
    assert [tuple(r["v"]) if r["v"] else None for r in made] == [at["Berlin"], at["Germany"], at["Berlin"], at["UK"], at["SF"], None, None]
    us = [("The USA", " NYC "), ("us", "dc"), ("aus", "nyc"), ("United States of America", "Atlantis"), (None, "nyc"), ("us", None)]
    made = spark.createDataFrame(us, "land string, city string").select(G.us_position_of(F.col("land"), F.col("city")).alias("v")).collect()
    assert [tuple(r["v"]) if r["v"] else None for r in made] == [G.US_CITIES["nyc"], G.US_CITIES["dc"], None, None, None, None]


def test_fields(spark):
    assert values(spark, FF.leading_year, ["2010-04-01", "1899", "2101", "nan", "c. 2004", " 1900 ", "", None]) == [2010, None, None, None, None, 1900, None, None]
    assert values(spark, FF.least_employees, ["51-100", "10000+", "1-10", "10,000", "none", "", None]) == [51, 10000, 1, 10, None, None, None]
    assert values(spark, FF.amount, ["0", "-0.0", "12e3", " 7 ", "1.5f", "n/a", "", None]) == [None, None, 12000.0, 7.0, None, None, None, None]
    assert values(spark, FF.deal_size, ["0", "1.5", "x", None]) == [0.0, 1_500_000.0, None, None]


def test_categories(spark):
    assert values(spark, FF.verticals_of_groups, ["Apps, Software,Video", "Other", "software", "", None]) == [["Software & IT", "Media & Marketing"], [], [], [], []]
    assert values(spark, FF.vertical_of_industry, [" Media ", "Other Business Products and Services", None]) == [["Media & Marketing"], [], []]
    assert values(spark, FF.ai_tags, ["Machine Learning, SaaS,Machine Learning", "Industrial Robotics (heavy)", "Big Data", None]) == [["machine-learning"], ["industrial-robotics-heavy"], ["big-data"], []]
    rows = spark.createDataFrame([("x", "Artificial Intelligence (AI)"), ("MLOps", "Software"), ("Big Data", None), (None, None)], "c string, g string")
    assert [r[0] for r in rows.select(FF.ai_score(F.col("c"), F.col("g"))).collect()] == [0.9, 0.75, 0.6, 0.6]


def test_scrub(spark):
    rows = [("In 1999 and 2031 BERLIN (x), german.", "berlin (x)", "Germany"), ("a\\Eb\\Ec", "A\\eB", None), ("x1999 U.S. u.s.a 1899", "", ""), (None, "x", "y"), ("ÉVRY 2020", "évry", None)]
    made = spark.createDataFrame(rows, "t string, city string, land string").select(K.scrub(F.col("t"), F.col("city"), F.col("land")).alias("v")).collect()
    assert [r["v"] for r in made] == ["In [YEAR] and 2031 [PLACE], [PLACE].", "[PLACE]\\Ec", "x1999 U.S. [PLACE]a [YEAR]", "", "[PLACE] [YEAR]"]
    assert values(spark, K.answered, ["2010.0", "2010", "2040.0", " Unknown ", "N/A", "Berlin", "", None]) == ["2010", "2010", "2040.0", None, None, "berlin", None, None]


def test_masked_places_equal_a_pattern(spark):
    draw = random.Random(5)
    phrases = ("new york", "york", "york new", "delhi", "new delhi", "st. louis", "köln", "a", "a b", "b a b")
    words = ["New", "YORK", "new", "york", "delhi", "st.", "louis", "köln", "a", "b", "é", "_a", "x"]
    texts = ["".join(draw.choice(words) + draw.choice([" ", " ", ",", "", "  "]) for _ in range(draw.randrange(30))) for _ in range(2000)] + ["", None, "a " * 50_000]
    by_length = "|".join(re.escape(p) for p in sorted(phrases, key=len, reverse=True))
    pattern = re.compile(rf"(?<!\w)(?:{by_length})(?!\w)", re.I)
    want = [None if t is None else pattern.sub(K.PLACE_MASK, t) for t in texts]
    assert values(spark, lambda c: K.mask_places(c, phrases), texts) == want
    assert values(spark, lambda c: K.mask_places(c, ()), ["x"]) == ["x"]


def test_more_pages(spark):
    want = {"View MORE": True, "x?page = 2": True, "&p=3": True, "/page/4": True, "/p/x": False, "?cursor=": True, "page 2 of 9": True, "pages 2 of 9": False, "1–20 of 90": True, "nothing": False, "": False, None: False}
    assert values(spark, R.more_pages, list(want)) == list(want.values())
    rows = spark.createDataFrame([(True, 19, True), (True, 20, True), (True, 3, False), (False, 3, True)], "good boolean, n int, more boolean")
    made = rows.select(R.escalated(F.col("good"), F.lit("r"), F.col("n"), F.col("more")).alias("v")).collect()
    assert [r["v"]["is_good"] for r in made] == [False, True, True, False]
    assert made[0]["v"]["reason"].startswith("r | Escalation: 19 < 20 while") and made[3]["v"]["reason"] == "r"


SCHEMA = "id int, bucket string, status string, ai_application string, ai_subfield string, domain string, capability string, label string, cluster int, n string"


def mapped(i, app, sub, domain, cluster=2, bucket="hidden"):
    return (i, bucket, "mapped", app, sub, domain, "Gen", f"l{cluster}", cluster, "kept")


def pending(i, app, sub, status="pending"):
    return (i, "hidden", status, app, sub, "old", "old", "old", 99, "kept")


def test_promotion(spark):
    rows = [mapped(i, "law", "nlp", "Legal" if i < 9 else "Media", 10 if i % 2 else 9) for i in range(16)]  # 9 of 16 are over .55; clusters tie
    rows += [mapped(100 + i, "law", "vision", "Legal") for i in range(14)]  # too few
    rows += [mapped(200 + i, "art", "nlp", "A" if i % 2 else "B") for i in range(20)]  # no plurality
    rows += [mapped(300 + i, "law", "other", "Legal") for i in range(20)] + [mapped(400 + i, None, "nlp", "X") for i in range(20)]
    rows += [mapped(500 + i, "art", "vision", "Legal", bucket="published") for i in range(20)]  # not hidden
    rows += [mapped(600, "care", "x", "Healthcare", 7), mapped(601, "care", "x", "Healthcare", 7), mapped(602, "care", "x", "Healthcare", 3)]
    waiting = [("law", "nlp"), ("law", "vision"), ("art", "nlp"), ("law", "other"), (None, "nlp"), ("art", "vision"), ("healthcare", None), ("healthcare", "nlp"), (None, None)]
    rows += [pending(1000 + k, *pair) for k, pair in enumerate(waiting)] + [pending(2000, "law", None, "category_mapped")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r)[:2] for r in learned_combinations(df).select("ai_application", "ai_subfield").collect()] == [("law", "nlp")]
    once = promote_pending(df)
    assert once.columns == df.columns and dict(once.dtypes) == dict(df.dtypes)
    got = {r["id"]: r for r in once.collect()}
    assert len(got) == len(rows)
    assert {i for i in got if got[i]["status"] == "category_mapped"} == {1000, 1006, 1007}
    # the smaller number of tied clusters, not the smaller string
    assert tuple(got[1000])[5:] == ("Legal", "Gen", "l10", 9, "kept")
    assert tuple(got[1006])[5:] == ("Healthcare", "Other", "l7", 7, "kept")
    assert tuple(got[2000])[2:9] == ("pending", "law", None, PENDING, "Other", "law", -1)
    assert tuple(got[1001])[5:9] == ("old", "old", "old", 99)
    again = {r["id"]: r for r in promote_pending(once).collect()}
    assert all(again[i] == got[i] for i in got)


@pytest.mark.parametrize("rows", [[], [pending(1, "healthcare", "nlp")]])
def test_promotion_without_examples(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, promote_pending(df).collect())) == sorted(rows)


def test_scope_of_questions(spark):
    from ventura.functions import scope as Q

    tags, places = ["llm", "rag"], ["Paris", "Köln", "Rio de Janeiro"]
    made = lambda names, needle: F.array(*(F.struct(F.lit(n).alias("name"), needle(F.lit(n)).alias("needle")) for n in names))
    vocabulary = F.array(*(F.struct(F.lit(n).alias("name"), Q.needles(F.lit(n)).alias("needles")) for n in tags))
    ask = lambda q: Q.scope_of(q, vocabulary, made(places, Q.place_needle), made(["France", "India"], Q.place_needle))
    want = {
        "language-model or language models?": ("category", "llm", None, None, False, False, False),
        "ragtime": ("overview", None, None, None, False, False, False),
        "RAG and LLM": ("category", "llm", None, None, False, False, False),
        "rag in Köln, France": ("place", "rag", "Köln", None, False, False, False),
        "rag in kölns": ("category", "rag", None, None, False, False, False),
        "india, rio de janeiro": ("place", None, "Rio de Janeiro", None, False, False, False),
        "India outside the US": ("place", None, None, None, True, False, False),
        "hidden and growing": ("hidden", None, None, None, False, True, False),
        "which AI sectors for rag": ("momentum", None, None, None, False, False, True),
        "hot": ("momentum", None, None, None, False, False, False),
        "": ("overview", None, None, None, False, False, False),
        None: ("overview", None, None, None, False, False, False),
    }
    assert [tuple(v) for v in values(spark, ask, list(want))] == list(want.values())


def test_equal_indexes_whatever_the_session_does_with_equal_keys(spark):
    answer = '{"verdicts": [{"index": 1, "is_ai": true}, {"index": 0}, {"index": "1", "is_ai": false}, {"index": 0, "is_ai": true}, {"index": 3}, {"is_ai": true}]}'
    before = spark.conf.get("spark.sql.mapKeyDedupPolicy")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "EXCEPTION")  # Spark's own default
    try:
        rows = spark.createDataFrame([(answer, ["a", "b", "c"]), ("sorry", ["d"]), (None, ["e"])], "answer string, ids array<string>")
        found = [[tuple(v) for v in r[0]] for r in rows.select(R.aligned_verdicts(F.col("answer"), F.col("ids"))).collect()]
    finally:
        spark.conf.set("spark.sql.mapKeyDedupPolicy", before)
    assert found == [[("a", True), ("b", False)], [], []]
