"""Classification, places, checks of answers and failure triage, each over texts made from the driver tables so that every branch is met."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ventura.functions import places as L
from ventura.functions import rules as R
from ventura.functions.text import canonicalize_domain
from ventura.plans.catalogue import plan
from ventura.plans.model import Tables

_EDGE = r"[^\p{L}\p{N}\p{M}_]"
_SPACE = r"[\t-\r \x{85}\p{Z}]"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(map(_text, items)) + "]"


def _pick(items, index: str) -> str:
    """An element of a fixed list, in SQL that Spark and DuckDB both read."""
    return "CASE " + " ".join(f"WHEN {index} % {len(items)} = {k} THEN {_text(x)}" for k, x in enumerate(items)) + " END"


_TOPICS = ("multi-agent swarm", "RAG", "fine-tuning llama", "vllm serving", "object detection ocr", "whisper speech", "web crawl dataset", "benchmark metrics", "sdk toolkit", "pytorch", "chatbot demo", "", "kubernetes", "drag and untrained ragtime", "text-to-image", "datasets")
_REPOS = f"SELECT doc_id, {_pick(_TOPICS, 'doc_id')} AS topic, CASE WHEN doc_id % 3 > 0 THEN {_pick(('a tool', 'an app', 'data', 'infra for it', 'nothing'), 'doc_id')} END AS description, text FROM documents"


def _first_sql(rules: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(blob, '(?i)(^|{_EDGE})({w})($|{_EDGE})') THEN '{n}'" for n, w in rules.items()) + " ELSE 'Other' END"


@plan("P15_classify_repo", f"""
SELECT doc_id, {_first_sql(R.SUBDOMAINS)} AS subdomain, {_first_sql(R.LAYERS)} AS layer FROM (SELECT doc_id, concat_ws(' ', topic, topic, description, left(text, 3000)) AS blob FROM ({_REPOS}))""")
def p15(t: Tables) -> DataFrame:
    """Subdomain and layer of repositories whose readmes are the documents."""
    rows = t.spark.sql(_REPOS.replace("FROM documents", "FROM {documents}"), documents=t.documents)
    made = R.classify_repo(F.array("topic", "topic"), F.col("description"), F.col("text"))
    return rows.withColumn("c", made).select("doc_id", "c.subdomain", "c.layer")


_CLAIMS = ("Aida makes maine lobster", "an AI tool", "ai-powered bikes", "Software for farms", "llms and such", "LLM", "rag-tag band", "storage", "no-code data", "machine  learning", "Machine Learning", "chai, tea", "web3 games", "datasets", "deep learning for x.ai")
_FIRMS = f"SELECT id, name, CASE WHEN id % 5 > 0 THEN {_pick(_CLAIMS, 'id')} END AS description, CASE WHEN id % 7 = 0 THEN 'fintech' WHEN id % 7 = 1 THEN '' END AS tags FROM companies"


def _word_sql(words) -> str:
    escaped = "|".join(w.replace("-", r"\-") for w in words)
    return f"regexp_matches(lower(blob), '(^|[^a-z0-9])({escaped})($|[^a-z0-9])')"


@plan("P16_classify_ai", f"""
SELECT id, ai AS is_ai, CASE WHEN ai OR NOT tech THEN 1.0 ELSE 0.5 END AS confidence, CASE WHEN ai OR NOT tech THEN 'keyword' ELSE 'keyword_only' END AS source
FROM (SELECT id, {_word_sql((*R.AI_WORDS, 'ai'))} AS ai, {_word_sql(R.TECH_WORDS)} AS tech FROM (SELECT id, concat_ws(' ', name, description, nullif(tags, '')) AS blob FROM ({_FIRMS})))""", "companies")  # fmt: skip
def p16(t: Tables) -> DataFrame:
    rows = t.spark.sql(_FIRMS.replace("FROM companies", "FROM {companies}"), companies=t.companies)
    return rows.withColumn("v", R.classify_ai(F.col("name"), F.col("description"), F.col("tags"))).select("id", "v.is_ai", F.col("v.confidence").cast("double").alias("confidence"), "v.source")


_TITLES = ("Generative adversarial design", "AI", "paid trial", "An ai-x rig", "autonomously", "Autonomous boats", "LLMs", "natural language", "generative art", "foundation models", "Neural Networks", "bridges", "computer  vision")


@plan("P17_looks_ai", f"SELECT id, regexp_matches(title, '(?i){'|'.join(R.AI_TITLES)}') AS looks_ai FROM (SELECT id, concat(name, ' ', {_pick(_TITLES, 'id')}) AS title FROM companies)", "companies")
def p17(t: Tables) -> DataFrame:
    rows = t.companies.selectExpr("id", f"concat(name, ' ', {_pick(_TITLES, 'id')}) AS title")
    return rows.select("id", R.looks_ai(F.col("title")).alias("looks_ai"))


_VINTAGES = ("we ship bikes", "Generative AI for bikes", "genAI and LLM tools", "ChatGPT plugin", "agentic co-pilot", "stable diffusion", "foundation models", "RAG, prompt engineering", "multi-modal search by OpenAI", "ragged llms")
_DESCRIBED = f"SELECT id, {_pick(_VINTAGES, 'id')} AS before, {_pick(_VINTAGES, '(id * 7 + 3)')} AS after FROM companies"


@plan("P18_new_vocabulary", f"""
SELECT id, len(x) = 0 AND len(y) > 0 AS added_any, list_filter(y, lambda w: NOT list_contains(x, w)) AS added FROM (SELECT id,
  list_filter({_list(R.GEN_AI)}, lambda w: regexp_matches(before, m[w])) AS x, list_filter({_list(R.GEN_AI)}, lambda w: regexp_matches(after, m[w])) AS y
  FROM (SELECT *, MAP {{{', '.join(f"{_text(k)}: {_text('(?i)' + v)}" for k, v in R.GEN_AI.items())}}} AS m FROM ({_DESCRIBED})))""", "companies")  # fmt: skip
def p18(t: Tables) -> DataFrame:
    """Terms of generative AI that a later description has and an earlier one lacks, and whether those are its first."""
    rows = t.spark.sql(_DESCRIBED.replace("FROM companies", "FROM {companies}"), companies=t.companies)
    x, y = R.gen_ai_terms(F.col("before")), R.gen_ai_terms(F.col("after"))
    return rows.select("id", ((F.size(x) == 0) & (F.size(y) > 0)).alias("added_any"), F.array_except(y, x).alias("added"))


_PREFIXES = ("", "See https://a.io/x?y=1, www.b.org. ", "Tom &amp; Jerry&#39;s &lt;b&gt; x27 quot ", "SBIR awardee ", "the project has a work package ", "Horizon 2020 project 2019 ", "120 followers on shop.com/x twitter com ", "A consortium ", "Phase II project ")
_RAW = f"SELECT doc_id, concat({_pick(_PREFIXES, 'doc_id')}, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 = 1 THEN left(text, 60) ELSE text END) AS raw FROM documents"


def _clean_sql(raw: str) -> str:
    out = raw
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, {_text(entity)}, {_text(c)})"
    for p in (R.CUT_URL, R.CUT_ENTITY, R.CUT_BOILERPLATE):
        unicode = p.replace(r"\S", f"[^{_SPACE[1:]}").replace(r"\s", _SPACE)
        out = f"regexp_replace({out}, {_text('(?i)' + unicode)}, ' ', 'g')"
    return f"trim(regexp_replace({out}, '{_SPACE}+', ' ', 'g'))"


@plan("P20_clean_text", f"""
SELECT doc_id, sha256(clean) AS clean_sha256, length(clean) AS clean_len, is_grant, NOT is_grant AND length(clean) >= 40 AND length(clean)::DOUBLE / greatest(length(raw), 1) >= 0.4 AS keep
FROM (SELECT *, len(list_filter({_list(R.GRANT_STRONG)}, lambda p: contains(' ' || lower(clean) || ' ', p))) > 0 OR len(list_filter({_list(R.GRANT_WEAK)}, lambda p: contains(' ' || lower(clean) || ' ', p))) >= 2 AS is_grant
  FROM (SELECT doc_id, coalesce(raw, '') AS raw, {_clean_sql("coalesce(raw, '')")} AS clean FROM ({_RAW})))""")
def p20(t: Tables) -> DataFrame:
    rows = t.spark.sql(_RAW.replace("FROM documents", "FROM {documents}"), documents=t.documents)
    rows = rows.select("doc_id", F.coalesce("raw", F.lit("")).alias("raw")).withColumn("clean", R.clean_description(F.col("raw")))
    return rows.select("doc_id", F.sha2("clean", 256).alias("clean_sha256"), F.length("clean").cast("long").alias("clean_len"), R.is_grant(F.col("clean")).alias("is_grant"), R.keeps_text(F.col("raw"), F.col("clean")).alias("keep"))


_WRITTEN = ("USA", " us; Boston", "England/Wales", "Czechia", "de", "EL", "Viet Nam", "Boston", "", "France", "kr / Seoul", "Israel (State of)", "Kazakhstan", "South Africa", "jp", "au;nz", "Chile", "Kosovo", "TX", "ng")
_PLACED = f"SELECT id, CASE WHEN id % 23 > 0 THEN {_pick(_WRITTEN, 'id')} END AS raw FROM companies"
_MAP = lambda table: "MAP {" + ", ".join(f"{_text(k)}: {_text(v)}" for k, v in table.items()) + "}"
_NAME = "trim(split_part(split_part(raw, ';', 1), '/', 1))"
_NORMAL = f"SELECT id, raw, CASE WHEN raw <> '' THEN coalesce({_MAP(L.ALIASES)}[lower({_NAME})], {_NAME}) END AS country FROM ({_PLACED})"


@plan("P22_normalize_country", f"SELECT id, country FROM ({_NORMAL})", "companies")
def p22(t: Tables) -> DataFrame:
    rows = t.spark.sql(_PLACED.replace("FROM companies", "FROM {companies}"), companies=t.companies)
    return rows.select("id", L.normalize_country(F.col("raw")).alias("country"))


@plan("P23_regions", f"""
SELECT continent, region, count(DISTINCT country) AS countries, count(*) AS n FROM (SELECT country, region, {_MAP(L.CONTINENT_OF)}[region] AS continent FROM (
  SELECT CASE WHEN list_contains({_list(L.COUNTRIES)}, country) THEN country END AS country, CASE WHEN list_contains({_list(L.COUNTRIES)}, country) THEN {_MAP(L.REGION_OF)}[country] END AS region FROM ({_NORMAL}))) GROUP BY 1, 2""", "companies")  # fmt: skip
def p23(t: Tables) -> DataFrame:
    """Recognised countries and rows per region; values that are no country have no region."""
    raw = F.col("raw")
    rows = t.spark.sql(_PLACED.replace("FROM companies", "FROM {companies}"), companies=t.companies)
    rows = rows.select(L.country_continent(raw).alias("continent"), L.country_region(raw).alias("region"), L.known_country(raw).alias("country"))
    return rows.groupBy("continent", "region").agg(F.countDistinct("country").alias("countries"), F.count("*").alias("n"))


_SUFFIXES = (".co.uk", ".uk", ".com.au", ".de", ".ai", ".example.fr", ".org.uk", ".net.br", ".x.com.sg", ".io", ".lt", ".co.jp", ".jp", ".com")
_HOSTS = f"SELECT page_id, concat(split_part(split_part(split_part(url, '://', 2), '/', 1), '.', 1), {_pick(_SUFFIXES, 'page_id')}) AS host FROM pages"


@plan("P25_tld_country", f"SELECT page_id, arg_max(code, length(ending)) AS country FROM ({_HOSTS}) LEFT JOIN (VALUES {', '.join(f'({_text(k)}, {_text(v)})' for k, v in L.ENDING_OF.items())}) e(ending, code) ON ends_with(lower(host), '.' || ending) GROUP BY 1")
def p25(t: Tables) -> DataFrame:
    """The country that the longest known ending of a host tells."""
    rows = t.spark.sql(_HOSTS.replace("FROM pages", "FROM {pages}"), pages=t.pages)
    return rows.select("page_id", L.ending_country(F.col("host")).alias("country"))


_TAILS = ("com", "co.uk", "ck", "b.ck", "www.ck", "x.www.ck", "org.uk", "city.kawasaki.jp", "a.kawasaki.jp", "kawasaki.jp", "school.nz", "io", "x.y.np", "github.io")
_URLS = f"SELECT page_id, concat(CASE WHEN page_id % 3 = 0 THEN 'HTTPS://www.' WHEN page_id % 3 = 1 THEN '' ELSE 'http://u@' END, CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'Shop.' ELSE concat(split_part(split_part(split_part(url, '://', 2), '/', 1), '.', 1), '.') END, CASE WHEN page_id % 19 = 0 THEN '10.0.0.1' ELSE {_pick(_TAILS, 'page_id')} END, CASE page_id % 4 WHEN 0 THEN ':80/a' WHEN 1 THEN '?q=/b' WHEN 2 THEN '/' ELSE '' END) AS url FROM pages"
_OWN_HOST = r"regexp_replace(regexp_replace(regexp_extract(regexp_replace(lower(trim(url)), '^https?://', ''), '^([^/?#]*)', 1), '^.*@|:.*$', '', 'g'), '^www\.', '')"
_EXACT, _WILD, _OUT = [r for r in L.SUFFIX_RULES if r[0] not in "*!"], [r[2:] for r in L.SUFFIX_RULES if r[:2] == "*."], [r[1:] for r in L.SUFFIX_RULES if r[0] == "!"]


@plan("P01_canonicalize_domain", f"""
SELECT page_id, CASE WHEN regexp_matches(h, '^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+$') OR s = 1 THEN h ELSE array_to_string(p[s - 1:], '.') END AS domain FROM (
  SELECT *, coalesce(list_filter(range(1, len(p) + 1), lambda k: list_contains({_list(_OUT)}, array_to_string(p[k:], '.')))[1] + 1,
    list_filter(range(1, len(p) + 1), lambda k: list_contains({_list(_EXACT)}, array_to_string(p[k:], '.')) OR k < len(p) AND list_contains({_list(_WILD)}, array_to_string(p[k + 1:], '.')))[1], len(p)) AS s
  FROM (SELECT page_id, {_OWN_HOST} AS h, string_split({_OWN_HOST}, '.') AS p FROM ({_URLS})))""")  # fmt: skip
def p01(t: Tables) -> DataFrame:
    rows = t.spark.sql(_URLS.replace("FROM pages", "FROM {pages}"), pages=t.pages)
    return rows.select("page_id", canonicalize_domain(F.col("url")).alias("domain"))


@plan("P33_answer_json", "SELECT event_id, CASE WHEN event_id % 7 IN (3, 5) THEN NULL WHEN event_id % 7 = 2 THEN event_id ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def p33(t: Tables) -> DataFrame:
    """The JSON of answers: bare, fenced, among prose with brackets in strings, cut off, in a list, absent, behind an unclosed one."""
    i, props = F.col("event_id") % 7, F.col("props")
    quoted = F.concat(F.lit('Here {it is: '), F.lit("}"), F.lit(""))
    prose = F.concat(F.lit('So: {"note": "a } \\" ] brace", "more": [{"x": "]"}], "k": '), F.col("event_id").cast("string"), F.lit("} and } more"))
    answer = F.when(i == 0, props).when(i == 1, F.concat(F.lit("Sure:\n```json\n"), props, F.lit("\n```\nDone {"))).when(i == 2, prose).when(i == 3, F.rtrim(props, F.lit("}"))).when(i == 4, F.concat(F.lit("List "), F.lit("["), props, F.lit(", 1]"))).when(i == 5, F.concat(F.lit("None. "), quoted)).otherwise(F.concat(F.lit("\n "), props, F.lit("\n")))
    made = F.try_parse_json(R.answer_json(answer))
    return t.events.select("event_id", F.coalesce(F.try_variant_get(made, "$.k", "bigint"), F.try_variant_get(made, "$[0].k", "bigint")).alias("k"))


@plan("P33_verdict_alignment", """
SELECT c_custkey * 10 + i AS id, CASE WHEN i = 0 THEN c_custkey % 2 = 0 ELSE false END AS is_ai FROM customer, (SELECT unnest([0, 2]) AS i) WHERE c_custkey % 5 > 0 UNION ALL
SELECT c_custkey * 10 + 1, true FROM customer WHERE c_custkey % 5 > 0 AND c_custkey % 3 = 0""")
def p33_aligned(t: Tables) -> DataFrame:
    """Verdicts of a batch of three by index: out of order, twice, beyond the batch, without an index; some answers are no JSON."""
    key = F.col("c_custkey")
    middle = F.when(key % 3 == 0, F.lit('{"index": 1, "is_ai": true}, ')).otherwise("")
    first = F.concat(F.lit('{"index": "0", "is_ai": '), (key % 2 == 0).cast("string"), F.lit("}"))
    whole = F.concat(F.lit('{"verdicts": [{"index": 2}, {"index": 0, "is_ai": true}, '), middle, F.lit('{"is_ai": true}, {"index": 7, "is_ai": true}, '), first, F.lit("]}"))
    rows = t.customer.select(F.when(key % 5 > 0, whole).otherwise("sorry").alias("answer"), F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: key * 10 + i).alias("ids"))
    return rows.select(F.inline(R.aligned_verdicts(F.col("answer"), F.col("ids"))))


_ERRORS = ("", "HTTP 403", "Captcha page", "tavily returned nothing", "invalid JSON", "max_calls exceeded", "odd", "Rendering", "decode error")
_SITES = f"""SELECT event_id, CASE event_id % 13 WHEN 0 THEN 'dns_fail' WHEN 1 THEN 'timeout' END AS probe_error, CASE event_id % 11 WHEN 0 THEN 404 WHEN 1 THEN 429 WHEN 2 THEN NULL ELSE 200 END AS status_code, event_id % 29 = 0 AS parked,
  event_id % 3 > 0 AS reachable, 100 * (event_id % 9) AS content_length, event_id % 4 > 0 AS on_topic, event_id % 5 AS runs, event_id % 2 AS last_records, event_id % 6 AS failures, event_id % 7 > 2 AS has_instruction, {_pick(_ERRORS, 'event_id')} AS error, CASE WHEN event_id % 31 = 0 THEN 'Blocked' END AS reason FROM events"""
_BLOB = "lower(concat_ws(' ', error, reason))"
_SAYS = lambda words: "(" + " OR ".join(f"contains({_BLOB}, '{w}')" for w in words) + ")"


@plan("P36_failure_bucket", f"""
SELECT event_id, CASE WHEN probe_error = 'dns_fail' OR parked OR status_code = 404 OR (probe_error = 'timeout' AND runs = 0) THEN 'H_DEAD_SITE' WHEN reachable AND content_length > 500 AND NOT on_topic THEN 'I_OFFTOPIC'
  WHEN status_code = 429 OR {_SAYS(R.BLOCKED)} THEN 'C_HTTP_BLOCKED' WHEN {_SAYS(R.THIN)} THEN 'B_ANTI_BOT_JS' WHEN {_SAYS(R.UNPARSED)} THEN 'E_PARSE_FAIL' WHEN {_SAYS(R.SPENT)} THEN 'F_PAGINATION'
  WHEN runs > 0 AND last_records = 0 AND reachable THEN CASE WHEN has_instruction AND failures >= 2 THEN 'G_STRUCTURE_BROKEN' ELSE 'D_WRONG_URL' END WHEN runs = 0 AND reachable THEN 'A_NEVER_TRIED' ELSE 'Z_UNKNOWN' END AS bucket FROM ({_SITES})""")
def p36(t: Tables) -> DataFrame:
    rows = t.spark.sql(_SITES.replace("FROM events", "FROM {events}"), events=t.events)
    columns = ("probe_error", "status_code", "parked", "reachable", "content_length", "on_topic", "runs", "last_records", "failures", "has_instruction", "error", "reason")
    return rows.select("event_id", R.failure_bucket(*map(F.col, columns)).alias("bucket"))


_STORY = """SELECT o_orderkey, concat('Firm ', CAST(o_custkey AS STRING), ' raised $', CAST(CAST(floor(o_totalprice / 1000) AS INT) AS STRING), ',', lpad(CAST(CAST(floor(o_totalprice) % 1000 AS INT) AS STRING), 3, '0'), CASE o_orderkey % 4 WHEN 0 THEN '.0' WHEN 1 THEN '' WHEN 2 THEN '.05' ELSE '.06' END,
  ' in 2019 and -', CAST(o_orderkey % 50 AS STRING), CASE WHEN o_orderkey % 6 = 0 THEN '.04' WHEN o_orderkey % 6 = 1 THEN '.3' ELSE '' END, '% since 1850.') AS story,
  array(CAST(o_custkey AS DOUBLE), CAST(floor(o_totalprice) AS DOUBLE), CAST(-(o_orderkey % 50) AS DOUBLE), CASE WHEN o_orderkey % 3 = 0 THEN CAST(1850 AS DOUBLE) END) AS facts FROM orders"""
_ALLOWED = "flatten(list_transform(list_filter(facts, lambda f: f IS NOT NULL), lambda f: [f, abs(f), round_even(f, 1), round_even(f, 0), round_even(abs(f), 1), round_even(abs(f), 0)]))"


@plan("P41_numbers_check", f"""
SELECT o_orderkey, len(list_filter(list_transform(regexp_extract_all(story, '-?\\d[\\d,]*(?:\\.\\d+)?'), lambda n: CAST(replace(n, ',', '') AS DOUBLE)),
  lambda v: NOT (v = floor(v) AND v BETWEEN 1900 AND 2100) AND len(list_filter({_ALLOWED}, lambda a: abs(a - v) < 0.051)) = 0)) = 0 AS ok FROM ({_STORY.replace('array(', 'list_value(').replace('AS STRING', 'AS VARCHAR')})""")
def p41(t: Tables) -> DataFrame:
    """Whether every figure of a sentence on an order is one of the order's facts."""
    rows = t.spark.sql(_STORY.replace("FROM orders", "FROM {orders}"), orders=t.orders)
    return rows.select("o_orderkey", R.numbers_check_out(F.col("story"), F.col("facts")).alias("ok"))
