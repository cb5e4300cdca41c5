import pytest
from pyspark.sql import functions as F

from ventura.functions import stats as S
from ventura.functions import text as X
from ventura.operators.similarity import token_sort_ratio


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://www.example.com/page?q=1", "example.com"),
        ("HTTPS://WWW.EXAMPLE.COM", "example.com"),
        ("www.mysite.io", "mysite.io"),
        ("https://app.mycompany.com/dashboard", "mycompany.com"),
        ("https://www.company.co.uk", "company.co.uk"),
        ("", None),
        (None, None),
    ],
)
def test_canonical_domain(spark, url, want):
    assert one(spark, X.canonicalize_domain(F.col("u")), u=url) == want


@pytest.mark.parametrize(("domain", "ok"), [("mycompany.com", True), ("github.com", False), ("myproject.github.io", False), ("readthedocs.io", False), ("medium.com", False), ("localhost", False), ("192.168.1.1", False), ("", False)])
def test_product_domain(spark, domain, ok):
    assert one(spark, X.is_product_domain(F.col("d")), d=domain) is ok


@pytest.mark.parametrize(("name", "want"), [("OpenAI", "openai"), ("Acme, Inc.", "acme"), ("Foo Labs LLC", "foo"), ("  Big   Name ", "big name"), ("", None), (None, None), ("Inc.", None), ("Café Société", "café société")])
def test_normalise_name(spark, name, want):
    assert one(spark, X.normalize_company_name(F.col("n")), n=name) == want


def test_domains_in_text(spark):
    found = one(spark, X.extract_domains(F.col("t")), t="see https://myai.com/a, and https://www.example.com. again https://myai.com/b")
    assert found == ["myai.com", "example.com"]
    assert one(spark, X.extract_domains(F.col("t")), t="none") == []


@pytest.mark.parametrize(("a", "b", "low", "high"), [("Anthropic", "anthropic", 1, 1), ("Deep Mind Labs", "DeepMind", 0.7, 1), ("Google", "Microsoft", 0, 0.5), ("b a", "a b", 1, 1)])
def test_token_sort_ratio(spark, a, b, low, high):
    assert low <= one(spark, token_sort_ratio(F.col("a"), F.col("b")), a=a, b=b) <= high


def test_scores_keep_literal_stems(spark):
    def score(text):
        return one(spark, X.ai_score(F.array(F.lit("web")), F.col("t"), F.lit(False)), t=text)

    assert score("fine-tuning transformers") == 0
    # both words are of the strong list, which counts once; "machine learning" is of the moderate one
    assert score("transformer-based inference") == pytest.approx(0.2)
    assert score("transformer-based machine learning") == pytest.approx(0.3)


@pytest.mark.parametrize("domain", ["arxiv.org", "reddit.com", "discord.com", "stackoverflow.com", "dev.to", "a.kaggle.com", "en.wikipedia.org", "localhost:80", "127.1"])
def test_hosts_that_are_no_firms(spark, domain):
    assert one(spark, X.is_product_domain(F.col("d")), d=domain) is False


@pytest.mark.parametrize(("name", "want"), [("Acme Incorporated", "acme"), ("Acme Platform Sarl Pte", "acme"), ("Acme Company AG", "acme company ag"), ("a b-c Acme", "- acme")])
def test_normalise_name_by_word_edges(spark, name, want):
    assert one(spark, X.normalize_company_name(F.col("n")), n=name) == want.strip("- ")


def test_startup_rules(spark):
    null = F.lit(None).cast("string")
    assert one(spark, X.startup_score(F.lit("myai.com"), F.lit("Organization"), F.lit("Pricing and enterprise plans."), F.lit(True))) == pytest.approx(1.0)
    assert one(spark, X.startup_score(F.lit("github.com"), null, F.lit("founded by a startup"), F.lit(False))) == 0
    assert one(spark, X.startup_likelihood(F.lit("a.co"), F.lit("organization"), F.lit(True), F.lit("A tool"), F.lit("pricing, api and cloud"), F.lit(True))) == pytest.approx(1.0)
    assert one(spark, X.ai_mentioned(F.lit("Acme AI"), null)) and not one(spark, X.ai_mentioned(F.lit("Aim"), F.lit("a bakery")))
    assert one(spark, X.ai_tags(F.array(F.lit("LLM "), F.lit("python"), F.lit("ai")), F.lit("Vector  Database and transformer"))) == ["ai", "llm", "transformer"]


def test_homepage_order(spark):
    null = F.lit(None).cast("string")
    found = lambda a, b, c: one(spark, X.homepage_domain(a, b, c))
    assert found(F.lit("https://my-startup.com"), F.lit("https://blog.example.com"), F.lit("Check https://other.com")) == "my-startup.com"
    assert found(F.lit("https://github.com/a/b"), F.lit("https://mycompany.io"), null) == "mycompany.io"
    assert found(null, null, F.lit("see https://first.com\nOur website https://cool.com")) == "cool.com"
    assert found(null, null, F.lit("see https://first.com")) == "first.com" and found(null, null, null) is None


def test_wilson_and_odds(spark):
    lo, hi = S.wilson(F.lit(13579), F.lit(56981))
    assert (round(100 * one(spark, lo), 2), round(100 * one(spark, hi), 2)) == (23.48, 24.18)
    assert one(spark, S.wilson(F.lit(0), F.lit(0))[0]) is None
    ratio = S.odds_ratio(F.lit(13579), F.lit(56981), F.lit(80528), F.lit(650200))
    assert [round(one(spark, c), 3) for c in ratio] == [2.213, 2.168, 2.259]
    d = S.newcombe(F.lit(13579), F.lit(56981), F.lit(80528), F.lit(650200))
    assert [round(100 * one(spark, c), 2) for c in d] == [11.45, 11.09, 11.81]
    p, r, f = S.precision_recall(F.lit(65), F.lit(45), F.lit(14))
    assert [round(one(spark, c), 3) for c in (p, r, f)] == [0.591, 0.823, 0.688]
    assert abs(100 * one(spark, S.rogan_gladen(F.lit(0.123), F.lit(0.789), F.lit(0.906))) - 4.17) < 0.1
    assert one(spark, S.odds_ratio(F.lit(0), F.lit(5), F.lit(2), F.lit(5))[0]) > 0


def test_three_valued_predicate(spark):
    from ventura.functions.predicates import is_ai

    rows = spark.createDataFrame([(False, None, False, None), (False, 0.6, False, None), (False, 0.1, False, False)], "cb_ai_tagged boolean, ai_score double, ai_mentioned boolean, llm_ai_verified boolean")
    assert [r["p"] for r in rows.select(is_ai().alias("p")).collect()] == [None, True, False]
