"""Scalar functions over pages, documents, parts and firms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ventura.functions import text as X
from ventura.operators.similarity import fuzzy_name_match
from ventura.plans.catalogue import plan
from ventura.plans.model import Tables

_HOST = r"regexp_replace(regexp_extract(regexp_replace(lower(trim(url)), '^https?://', ''), '^([^/?#:]*)', 1), '^www\.', '')"
_REGISTRABLE = "CASE WHEN len({p}) <= 2 THEN {h} WHEN array_to_string({p}[-2:], '.') IN ('co.uk', 'com.au', 'co.kr', 'co.il', 'co.in', 'com.br', 'co.jp', 'com.mx', 'co.nz', 'co.za') THEN array_to_string({p}[-3:], '.') ELSE array_to_string({p}[-2:], '.') END"
_NOT_OWN = "^(.*\\.)?(github\\.com|github\\.io|gitlab\\.com|bitbucket\\.org|readthedocs\\.io|readthedocs\\.org|rtfd\\.io|docs\\.rs|pkg\\.go\\.dev|pypi\\.org|npmjs\\.com|medium\\.com|dev\\.to|substack\\.com|hashnode\\.dev|twitter\\.com|x\\.com|linkedin\\.com|facebook\\.com|youtube\\.com|reddit\\.com|discord\\.gg|discord\\.com|t\\.me|telegram\\.org|slack\\.com|arxiv\\.org|papers\\.ssrn\\.com|scholar\\.google\\.com|huggingface\\.co|kaggle\\.com|producthunt\\.com|theresanaiforthat\\.com|notion\\.so|notion\\.site|google\\.com|amazonaws\\.com|azure\\.com|wikipedia\\.org|stackoverflow\\.com)$"


def _own_sql(d: str) -> str:
    """Whether a domain is a firm's own."""
    return f"({d} <> '' AND NOT regexp_matches(lower({d}), '{_NOT_OWN}') AND NOT regexp_matches({d}, '^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+$') AND NOT starts_with(lower({d}), 'localhost') AND NOT starts_with({d}, '127.'))"


def _domains_sql(text: str) -> str:
    """Distinct registrable domains of a text's URLs, in order."""
    urls = f"regexp_extract_all({text}, 'https?://[^\\s\\)\\]\\}}>\"''`,;]+', 0, 'i')"
    hosts = f"list_transform({urls}, lambda u: regexp_replace(regexp_extract(regexp_replace(lower(rtrim(u, '.)],;:!?''\"')), '^https?://', ''), '^([^/?#:]*)', 1), '^www\\.', ''))"
    made = f"list_transform(list_filter({hosts}, lambda h: h <> ''), lambda h: {_REGISTRABLE.format(p=chr(39).join(['string_split(h, ', '.', ')']), h='h')})"
    return f"list_filter({made}, lambda d, i: list_position({made}, d) = i)"


#: Hosts that pages stand for in the plans of this rule, so that every branch is met.
_ODD_HOSTS = ("arxiv.org", "a.kaggle.com", "localhost:8080", "10.1.2.3", "127.0.0.1", "firm.dev", "dev.to", "notdev.to", "myfirm.co.uk")


@plan("P02_is_product_domain", f"SELECT page_id, d, {_own_sql('d')} AS ok FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN {_HOST} ELSE [{', '.join(repr(h) for h in _ODD_HOSTS)}][CAST(page_id % {len(_ODD_HOSTS)} AS INT) + 1] END AS d FROM pages)")
def p02(t: Tables) -> DataFrame:
    d = F.when(F.col("page_id") % 3 == 0, X.host(F.col("url"))).otherwise(F.get(F.array(*map(F.lit, _ODD_HOSTS)), (F.col("page_id") % len(_ODD_HOSTS)).cast("int")))
    return t.pages.select("page_id", d.alias("d")).withColumn("ok", X.is_product_domain(F.col("d")))


@plan("P03_domains_in_text", f"SELECT page_id, {_domains_sql('html')} AS domains FROM pages")
def p03(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.extract_domains(F.col("html")).alias("domains"))


@plan("P04_homepage_domain", f"""
SELECT page_id, coalesce(CASE WHEN {_own_sql('home')} THEN home END, list_filter(near, lambda d: {_own_sql('d')})[1], list_filter(listed, lambda d: {_own_sql('d')})[1]) AS domain
FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN {_REGISTRABLE.format(p=f"string_split({_HOST}, '.')", h=_HOST)} END AS home, {_domains_sql('html')} AS listed,
  {_domains_sql("array_to_string(list_filter(string_split(html, chr(10)), lambda x: regexp_matches(x, 'website|homepage|app|demo|waitlist|pricing|product|try it|get started|sign up|launch', 'i')), chr(10))")} AS near FROM pages)""")
def p04(t: Tables) -> DataFrame:
    """Every second page has a homepage; the others show what their text names."""
    home = F.when(F.col("page_id") % 2 == 0, F.col("url"))
    return t.pages.select("page_id", X.homepage_domain(home, F.lit(None).cast("string"), F.col("html")).alias("domain"))


@plan("P05_simple_domain", r"SELECT page_id, lower(split_part(regexp_replace(url, '^(https?://)?(www\.)?', ''), '/', 1)) AS d FROM pages")
def p05(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.simple_domain(F.col("url")).alias("d"))


#: Names with suffixes, single characters and punctuation around each part's name.
_NAMES = ("Labs, Inc.", "Pte. Ltd", "a b-c d", "Company AG", "Incorporated / SARL", "Platform-Technologies 7")
_NAMED = "(SELECT p_partkey, p_name || ' ' || [" + ", ".join(f"'{n}'" for n in _NAMES) + f"][CAST(p_partkey % {len(_NAMES)} AS INT) + 1] AS n FROM part)"


def _named(t: Tables) -> DataFrame:
    tail = F.get(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % len(_NAMES)).cast("int"))
    return t.part.select("p_partkey", F.concat("p_name", F.lit(" "), tail).alias("n"))


def name_sql(name: str, suffixes: str) -> str:
    """A firm's name for matching: punctuation, suffix words and single characters cut out."""
    out = f"regexp_replace(lower(trim({name})), '[^\\w\\s-]', ' ', 'g')"
    out = f"regexp_replace({out}, '\\b({suffixes})\\b\\.?', ' ', 'g')"
    out = f"trim(regexp_replace(regexp_replace({out}, '\\b\\w\\b', ' ', 'g'), '\\s+', ' ', 'g'))"
    return f"nullif(trim(trim({out}, '-')), '')"


FULL_SQL = "inc|incorporated|llc|ltd|limited|co|corp|corporation|labs|lab|ai|io|tech|technologies|technology|software|solutions|systems|platform|group|holding|holdings|gmbh|sa|sas|sarl|bv|pty|pte"
LEGAL_SQL = "|".join(X.LEGAL_SUFFIXES)


@plan("P06_normalize_name", f"SELECT p_partkey, {name_sql('n', FULL_SQL)} AS name FROM {_NAMED}")
def p06(t: Tables) -> DataFrame:
    return _named(t).select("p_partkey", X.normalize_company_name(F.col("n")).alias("name"))


@plan("P07_normalize_conservative", f"SELECT p_partkey, {name_sql('n', LEGAL_SQL)} AS name FROM {_NAMED}")
def p07(t: Tables) -> DataFrame:
    return _named(t).select("p_partkey", X.normalize_company_name(F.col("n"), X.LEGAL_SUFFIXES).alias("name"))


def sorted_sql(name: str) -> str:
    """Tokens of a normalised name in order."""
    return f"array_to_string(list_sort(list_filter(string_split({name}, ' '), lambda t: t <> '')), ' ')"


def lcs_sql(xs: str, ys: str) -> str:
    """Length of the longest common subsequence of two lists: a fold of one with the row of the other's lengths, each a running maximum."""
    cell = f"CASE WHEN {ys}[k] = ch THEN coalesce(r[k - 1], 0) + 1 ELSE r[k] END"
    row = f"list_transform(range(1, len({ys}) + 1), lambda i: list_max(list_transform(range(1, i + 1), lambda k: {cell})))"
    return f"coalesce(list_last(list_reduce({xs}, lambda r, ch: {row}, list_transform({ys}, lambda c: CAST(0 AS BIGINT)))), 0)"


def alike_sql(x: str, y: str) -> str:
    """Similarity of two texts."""
    xs, ys = f"string_split({x}, '')", f"string_split({y}, '')"
    return f"CASE WHEN {x} = {y} THEN 1.0 ELSE 2.0 * {lcs_sql(xs, ys)} / (length({x}) + length({y})) END"


@plan("P08_fuzzy_similarity", f"""
SELECT p_partkey, round(CASE WHEN x IS NULL OR y IS NULL THEN 0.0 ELSE {alike_sql('x', 'y')} END, 6) AS similarity FROM (
  SELECT a.p_partkey, {sorted_sql('a.name')} AS x, {sorted_sql('b.name')} AS y FROM (SELECT p_partkey, {name_sql('n', FULL_SQL)} AS name FROM {_NAMED}) a JOIN (SELECT p_partkey - 1 AS p_partkey, {name_sql('n', FULL_SQL)} AS name FROM {_NAMED}) b USING (p_partkey))""")  # fmt: skip
def p08(t: Tables) -> DataFrame:
    """Similarity of each part's name and the next part's."""
    b = _named(t).select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("n").alias("other"))
    return _named(t).join(b, "p_partkey").select("p_partkey", F.round(fuzzy_name_match(F.col("n"), F.col("other")), 6).alias("similarity"))


@plan("P09_entity_key", "SELECT id, coalesce('domain:' || lower(domain), 'name:' || trim(regexp_replace(lower(name), '[^a-z0-9_ -]', ' ', 'g'))) AS key FROM companies", "companies")
def p09(t: Tables) -> DataFrame:
    return t.companies.select("id", X.entity_key(F.col("domain"), F.col("name")).alias("key"))


_STRONG = r"\b(fine[- ]?tun|inference|transformer|diffusion|multimodal|large language model|retrieval.augmented|rag pipeline|vector.?database|embedding.?model|llm.?agent|text.?to.?image|speech.?to.?text|foundation model)\b"
_MODERATE = r"\b(artificial intelligence|machine learning|deep learning|neural net|computer vision|natural language|object detection|image classification|sentiment analysis|recommendation engine|model training|model serving|mlops|pytorch|tensorflow|jax|hugging\s?face|generative ai|gen ai|ai.powered|ai-driven|ai-enabled|predictive analytics|data science)\b"
_NAME_WORDS = r"\b(ai|ml|llm|gpt|nlp|agi|artificial intelligence|machine learning|deep learning|neural|generative)\b"
_STARTUP = r"\b(waitlist|pricing|book a demo|request demo|customers|enterprise|saas|api key|free trial|sign up|get started|early access|beta access|backed by|funded by|raised|series [a-d]|seed round|our platform|our product|we help|we build)\b"
_COMMERCIAL = r"\b(pricing|contact us|enterprise|cloud|api|signup|sign up|waitlist|book a demo|request demo|free trial|get started|early access|beta access|our platform|our product|we help|we build|backed by|funded by|raised|series [a-d]|seed round|customers|saas|managed service|hosted|on-prem)\b"
_STRONG_SQL = "['llm', 'rag', 'agents', 'generative-ai', 'generative_ai', 'large-language-model', 'large-language-models', 'langchain', 'llamaindex', 'autogen']"
_MODERATE_SQL = "['ai', 'machine-learning', 'deep-learning', 'computer-vision', 'nlp', 'natural-language-processing', 'neural-network', 'reinforcement-learning', 'speech-recognition', 'transformer', 'diffusion', 'multimodal']"
#: Texts, topics and domains that stand for a firm's own, so that every branch of the rules is met.
_BODIES = (
    "transformer-based Inference for fine-tuning LLMs", "A vector  database and a Vector-Database, with text to image diffusion", "An LLM chatbot; book a demo, pricing, free trial",
    "Bakery", "Deep learning for computer vision. Our platform helps customers", "Generative AI, series B, backed by many; api and cloud", "A web framework for building apps", "We build a tool",
)
_TOPICS = ("LLM ", "ai", "web", "rag", "computer-vision", "langchain", "Transformer")
_DOMAINS = ("github.com", "firm.dev", "docs.readthedocs.io", "arxiv.org", "a.co")
_OWNERS = ("Organization", "User", "organization")


def _pick_sql(values: tuple[str, ...], step: str = "id") -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][CAST({step} % {len(values)} AS INT) + 1]"


def _pick(values: tuple[str, ...]) -> Column:
    return F.get(F.array(*map(F.lit, values)), (F.col("id") % len(values)).cast("int"))


_SAMPLES = f"(SELECT id, name || CASE WHEN id % 4 = 0 THEN ' AI' WHEN id % 4 = 1 THEN ' Aim' ELSE '' END AS name, {_pick_sql(_BODIES)} AS body, {_pick_sql(_TOPICS)} AS topic, {_pick_sql(_DOMAINS)} AS site, {_pick_sql(_OWNERS)} AS owner, cb_ai_tagged, domain FROM companies)"


def _samples(t: Tables) -> DataFrame:
    tail = F.when(F.col("id") % 4 == 0, " AI").when(F.col("id") % 4 == 1, " Aim").otherwise("")
    return t.companies.select("id", F.concat("name", tail).alias("name"), _pick(_BODIES).alias("body"), _pick(_TOPICS).alias("topic"), _pick(_DOMAINS).alias("site"), _pick(_OWNERS).alias("owner"), "cb_ai_tagged", "domain")


def _case(*tests: tuple[str, float]) -> str:
    return " + ".join(f"CASE WHEN {t} THEN {p} ELSE 0 END" for t, p in tests)


def _words_sql(text: str, words: str) -> str:
    return f"regexp_matches(lower({text}), '{words}')"


_SCORE_SQL = _case((f"list_contains({_STRONG_SQL}, lower(trim(topic)))", 0.3), (f"list_contains({_MODERATE_SQL}, lower(trim(topic)))", 0.2), (_words_sql("body", _STRONG), 0.2), (_words_sql("body", _MODERATE), 0.1), ("cb_ai_tagged", 0.2))


@plan("P10_ai_score", f"SELECT id, round(least(1.0, {_SCORE_SQL})::DOUBLE, 6) AS score FROM {_SAMPLES}", "companies")
def p10(t: Tables) -> DataFrame:
    return _samples(t).select("id", F.round(X.ai_score(F.array("topic"), F.col("body"), F.col("cb_ai_tagged")), 6).alias("score"))


@plan("P11_ai_mentioned", f"SELECT id, {_words_sql('name', _NAME_WORDS)} OR {_words_sql('body', _STRONG)} OR {_words_sql('body', _MODERATE)} AS mentioned FROM {_SAMPLES}", "companies")
def p11(t: Tables) -> DataFrame:
    return _samples(t).select("id", X.ai_mentioned(F.col("name"), F.col("body")).alias("mentioned"))


_STARTUP_SQL = _case((_own_sql("site"), 0.4), ("lower(owner) = 'organization'", 0.2), (_words_sql("body", _STARTUP), 0.2), ("cb_ai_tagged", 0.2))


@plan("P12_startup_score", f"SELECT id, round(least(1.0, {_STARTUP_SQL})::DOUBLE, 6) AS score FROM {_SAMPLES}", "companies")
def p12(t: Tables) -> DataFrame:
    return _samples(t).select("id", F.round(X.startup_score(F.col("site"), F.col("owner"), F.col("body"), F.col("cb_ai_tagged")), 6).alias("score"))


_LIKELY_SQL = _case((_own_sql("site"), 0.3), ("lower(owner) = 'organization'", 0.15), ("domain IS NOT NULL", 0.1), ("n >= 3", 0.25), ("n BETWEEN 1 AND 2", 0.15), ("id % 5 = 0", 0.1), (_words_sql("body", r"\b(platform|product|api|service|tool|solution)\b"), 0.1))


@plan("P13_likelihood", f"SELECT id, round(least(1.0, {_LIKELY_SQL})::DOUBLE, 4) AS likelihood FROM (SELECT *, len(regexp_extract_all(lower(body), '{_COMMERCIAL}')) AS n FROM {_SAMPLES})", "companies")
def p13(t: Tables) -> DataFrame:
    score = X.startup_likelihood(F.col("site"), F.col("owner"), F.col("domain").isNotNull(), F.col("body"), F.col("body"), F.col("id") % 5 == 0)
    return _samples(t).select("id", score.alias("likelihood"))


@plan("P14_extract_tags", f"SELECT id, list_sort(list_distinct(list_concat(list_filter([lower(trim(topic))], lambda x: list_contains(list_concat({_STRONG_SQL}, {_MODERATE_SQL}), x)), list_transform(regexp_extract_all(lower(body), '{_STRONG}'), lambda w: regexp_replace(w, '\\s+', '-', 'g'))))) AS tags FROM {_SAMPLES}", "companies")
def p14(t: Tables) -> DataFrame:
    return _samples(t).select("id", X.ai_tags(F.array("topic"), F.col("body")).alias("tags"))




_STRIP = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b.*?</style\\s*>', ' ', 'g'), '(?is)<nav\\b.*?</nav\\s*>', ' ', 'g'), '(?is)<footer\\b.*?</footer\\s*>', ' ', 'g'), '(?is)<svg\\b.*?</svg\\s*>', ' ', 'g'), '(?s)<!--.*?-->|<[^>]*>', ' ', 'g')"


@plan("P19_visible_text", f"SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace({_STRIP}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS body FROM pages")
def p19(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.visible_text(F.col("html")).alias("body"))


@plan("P21_token_jaccard", """
SELECT item_id, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 9) AS j FROM (SELECT x.item_id, list_distinct(list_filter(regexp_split_to_array(lower(trim(x.text)), '\\s+'), lambda w: w <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(trim(y.text)), '\\s+'), lambda w: w <> '')) AS b FROM benchmark x JOIN benchmark y ON y.item_id = x.item_id + 1)""")
def p21(t: Tables) -> DataFrame:
    nxt = t.benchmark.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return t.benchmark.join(nxt, "item_id").select("item_id", F.round(X.token_jaccard(F.col("text"), F.col("other")), 9).alias("j"))


@plan("P27_batch_year", "SELECT id, CASE WHEN id % 3 = 0 THEN 2000 + CAST(substr(b, 2) AS INT) WHEN id % 3 = 1 THEN CAST(regexp_extract(b, '((?:19|20)[0-9]{2})', 1) AS INT) END AS y FROM (SELECT id, CASE id % 3 WHEN 0 THEN 'W' || lpad(CAST(id % 30 AS VARCHAR), 2, '0') WHEN 1 THEN 'Cohort ' || CAST(1990 + id % 30 AS VARCHAR) ELSE 'none' END AS b FROM companies)", "companies")
def p27(t: Tables) -> DataFrame:
    i = F.col("id")
    b = F.when(i % 3 == 0, F.concat(F.lit("W"), F.lpad((i % 30).cast("string"), 2, "0"))).when(i % 3 == 1, F.concat(F.lit("Cohort "), (1990 + i % 30).cast("string"))).otherwise("none")
    return t.companies.select("id", X.batch_year(b).alias("y"))


@plan("P32_tag_label", "SELECT DISTINCT p_type, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS label FROM part")
def p32(t: Tables) -> DataFrame:
    return t.part.select("p_type", X.tag_label(F.col("p_type")).alias("label")).distinct()


@plan("P34_vocabulary", "SELECT id, CASE WHEN segment IN ('MACHINERY', 'BUILDING') THEN segment ELSE 'other' END AS segment, CASE WHEN founded_year BETWEEN 2005 AND 2020 THEN founded_year END AS year FROM companies", "companies")
def p34(t: Tables) -> DataFrame:
    return t.companies.select("id", F.when(F.col("segment").isin("MACHINERY", "BUILDING"), F.col("segment")).otherwise("other").alias("segment"), F.when(F.col("founded_year").between(2005, 2020), F.col("founded_year")).alias("year"))


@plan("P37_dates", "SELECT o_orderkey, year(o_orderdate) AS y, strftime(o_orderdate, '%Y-%m') AS m, CAST(date_trunc('week', o_orderdate) AS DATE) AS w, year(o_orderdate) || CASE WHEN month(o_orderdate) <= 6 THEN 'H1' ELSE 'H2' END AS h FROM orders")
def p37(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    half = F.concat(F.year(d).cast("string"), F.when(F.month(d) <= 6, "H1").otherwise("H2"))
    return t.orders.select("o_orderkey", F.year(d).alias("y"), F.date_format(d, "yyyy-MM").alias("m"), F.to_date(F.date_trunc("week", d)).alias("w"), half.alias("h"))


@plan("P38_misc", "SELECT c_custkey, left(c_name, 8) AS head, md5(c_name) AS digest, nullif(c_mktsegment, 'BUILDING') AS segment, greatest(c_acctbal, 0) AS balance, try_cast(c_name AS INT) AS bad FROM customer")
def p38(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.left("c_name", F.lit(8)).alias("head"), F.md5("c_name").alias("digest"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), F.greatest("c_acctbal", F.lit(0.0)).alias("balance"), F.col("c_name").try_cast("int").alias("bad"))


@plan("P40_leaders_first", "SELECT l_orderkey, list(l_suppkey ORDER BY (l_returnflag <> 'A'), l_suppkey, l_linenumber)[1:6] AS people FROM lineitem GROUP BY 1")
def p40(t: Tables) -> DataFrame:
    people = F.array_sort(F.collect_list(F.struct((F.col("l_returnflag") != "A").alias("last"), "l_suppkey", "l_linenumber")))
    return t.lineitem.groupBy("l_orderkey").agg(people.alias("p")).select("l_orderkey", F.slice("p.l_suppkey", 1, 6).alias("people"))


@plan("P43_math", "SELECT c_custkey, round(sqrt(abs(c_acctbal)), 6) AS r, floor(c_acctbal) AS f, least(1, greatest(0, c_acctbal / 10000)) AS clipped, round(ln(1 + abs(c_acctbal)), 6) AS l FROM customer")
def p43(t: Tables) -> DataFrame:
    v = F.col("c_acctbal")
    return t.customer.select("c_custkey", F.round(F.sqrt(F.abs(v)), 6).alias("r"), F.floor(v).alias("f"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), v / 10000)).alias("clipped"), F.round(F.log(1 + F.abs(v)), 6).alias("l"))


@plan("P44_arrays", "SELECT company_id, len(t) AS n, array_to_string(list_sort(list_distinct(list_concat(t, ['NEW']))), ',') AS joined, list_sort(t)[1:2] AS head FROM (SELECT company_id, list(tag) AS t FROM firm_tags GROUP BY 1)", "firm_tags")
def p44(t: Tables) -> DataFrame:
    lists = t.firm_tags.groupBy("company_id").agg(F.collect_list("tag").alias("t"))
    return lists.select("company_id", F.size("t").cast("long").alias("n"), F.array_join(F.array_sort(F.array_union("t", F.array(F.lit("NEW")))), ",").alias("joined"), F.slice(F.array_sort("t"), 1, 2).alias("head"))


@plan("P45_maps", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) * 2 AS twice, json_extract(props, '$.z') IS NOT NULL AS has_z FROM events")
def p45(t: Tables) -> DataFrame:
    m = F.from_json("props", "map<string,bigint>")
    return t.events.select("event_id", (F.element_at(m, "k") * 2).alias("twice"), F.map_contains_key(m, "z").alias("has_z"))


@plan("P46_urls", "SELECT page_id, split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1) AS host, split_part(url, '://', 1) AS scheme FROM pages")
def p46(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.parse_url("url", F.lit("PROTOCOL")).alias("scheme"))


@plan("P47_casing", "SELECT c_custkey, CASE WHEN upper(c_mktsegment) = c_mktsegment THEN upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) ELSE c_mktsegment END AS segment FROM customer")
def p47(t: Tables) -> DataFrame:
    s = F.col("c_mktsegment")
    return t.customer.select("c_custkey", F.when(F.upper(s) == s, F.initcap(F.lower(s))).otherwise(s).alias("segment"))


@plan("P48_triage", "SELECT id, CASE WHEN ai_score >= 0.7 THEN 'accept' WHEN ai_score < 0.1 THEN 'reject' WHEN llm_ai_verified THEN 'accept' WHEN llm_ai_verified = false THEN 'reject' WHEN ai_score >= 0.35 THEN 'accept' ELSE 'reject' END AS verdict FROM companies", "companies")
def p48(t: Tables) -> DataFrame:
    s, v = F.col("ai_score"), F.col("llm_ai_verified")
    return t.companies.select("id", F.when(s >= 0.7, "accept").when(s < 0.1, "reject").when(v, "accept").when(~v, "reject").when(s >= 0.35, "accept").otherwise("reject").alias("verdict"))
