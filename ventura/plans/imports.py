"""Fields, places and categories of imported firms, masking, the taxonomy's last step and the scope of questions, over values that meet every branch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ventura.functions import firm_fields as FF
from ventura.functions import gazetteer as G
from ventura.functions import masking as K
from ventura.functions import places as L
from ventura.functions import predicates as P
from ventura.functions import rules as R
from ventura.functions import scope as Q
from ventura.operators import taxonomy as X
from ventura.plans.aggregates import AI
from ventura.plans.catalogue import plan
from ventura.plans.model import Tables
from ventura.plans.rules import _EDGE, _MAP, _list, _pick, _text


def _rows(t: Tables, sql: str, table: str) -> DataFrame:
    """A query that DuckDB and Spark both read, over one table or view."""
    return t.spark.sql(sql.replace(f"FROM {table}", f"FROM {{{table}}}").replace("AS VARCHAR", "AS STRING"), **{table: getattr(t, table)})


_WRITTEN = ("USA", " usa ", "gbr", "Czechia", "CZE", "England", "Earth", "", "Peru", "France; x", "jp", "TX", "Kosovo", "korea", "LKA", "per", "united states / x")
_PLACED = f"SELECT id, CASE WHEN id % 23 > 0 THEN {_pick(_WRITTEN, 'id')} END AS raw FROM companies"
_NORMAL = f"SELECT id, v, CASE WHEN v <> '' THEN coalesce({_MAP(L.ALIASES)}[lower(w)], w) END AS name FROM (SELECT *, trim(split_part(split_part(v, ';', 1), '/', 1)) AS w FROM (SELECT id, trim(raw) AS v FROM ({_PLACED})))"


@plan("P24_clean_country", f"SELECT id, coalesce({_MAP(G.ISO3)}[upper(v)], CASE WHEN list_contains({_list((*L.COUNTRIES, *G.ISO3.values()))}, name) THEN name END) AS country FROM ({_NORMAL})", "companies")
def p24(t: Tables) -> DataFrame:
    return _rows(t, _PLACED, "companies").select("id", G.clean_country(F.col("raw")).alias("country"))


_LOCATIONS = (
    "San Francisco, CA", "London, United Kingdom", "Berlin, Germany", "Singapore", "Fresno, C.A.", "Remote", "Paris, Ile-de-France, FR", "Lyon, Gondor", " Usa ", "", "nan", "Vianden, Luxembourg", "Boston | Remote",
    "Earth", "greater new  york area", "Fresno, TX", "x / Kenya", "São Paulo", "Köln, DE", "Washington, DC", "Berlin · Germany", "Piran, Slovenia", "Cambridge, MA, area", "X, 1A", "united states", "A,,", "parishes", "Tel Aviv-Yafo", "None", "x, Wales", "Jeju, Korea",
)
_LOCATED = f"SELECT c_custkey, CASE WHEN c_custkey % 41 > 0 THEN {_pick(_LOCATIONS, 'c_custkey')} END AS loc FROM customer"


def _place_sql(names: dict[str, str], us: str, own_code: str, nothing: str) -> str:
    known = lambda key: f"{_MAP(names)}[{key}]"
    return f"""SELECT c_custkey, CASE WHEN {nothing} THEN NULL WHEN len(p) > 1 THEN CASE WHEN {us} THEN 'US' ELSE coalesce({known('lower(p[-1])')}, CASE WHEN {own_code} THEN upper(p[-1]) END, p[-1]) END ELSE {known('lower(trim(loc))')} END AS country,
  CASE WHEN {nothing} THEN NULL WHEN len(p) > 1 THEN p[1] WHEN {known('lower(trim(loc))')} IS NULL THEN trim(loc) END AS city FROM (SELECT *, list_transform(string_split(loc, ','), lambda x: trim(x)) AS p FROM ({_LOCATED}))"""


@plan("P26_location_parts", _place_sql(G.LOCATION_COUNTRIES, f"list_contains({_list(G.STATES)}, lower(p[-1])) OR list_contains({_list(G.STATES)}, replace(lower(p[-1]), '.', ''))", "length(p[-1]) = 2", "loc = '' OR loc IS NULL"))
def p26(t: Tables) -> DataFrame:
    return _rows(t, _LOCATED, "customer").withColumn("at", G.location_of(F.col("loc"))).select("c_custkey", "at.country", "at.city")


@plan("P26_deal_location", _place_sql(G.LOCATION_COUNTRIES | G.DEAL_COUNTRIES, "false", "regexp_full_match(p[-1], '\\p{L}{2}')", "loc IS NULL OR lower(loc) IN ('', 'nan', 'none')"))
def p26_deal(t: Tables) -> DataFrame:
    return _rows(t, _LOCATED, "customer").withColumn("at", G.deal_location_of(F.col("loc"))).select("c_custkey", "at.country", "at.city")


def _known_sql(v: str) -> str:
    cut = f"trim(split_part(split_part({v}, ';', 1), '/', 1))"
    name = f"coalesce({_MAP(L.ALIASES)}[lower({cut})], {cut})"
    return f"CASE WHEN {v} <> '' AND list_contains({_list(L.COUNTRIES)}, {name}) THEN {name} END"


_CITY = f"{_MAP(G.CITY_COUNTRY)}"


@plan("P26_profile_country", f"""
SELECT c_custkey, CASE WHEN direct IS NOT NULL THEN direct WHEN listed IS NOT NULL THEN listed WHEN among IS NOT NULL THEN {_CITY}[among] WHEN state THEN 'United States' ELSE behind END AS country,
  CASE WHEN direct IS NOT NULL THEN 0.95 WHEN listed IS NOT NULL THEN 0.85 WHEN among IS NOT NULL THEN 0.75 WHEN state THEN 0.8 WHEN behind IS NOT NULL THEN 0.9 ELSE 0 END::DOUBLE AS confidence
FROM (SELECT c_custkey, {_known_sql('raw')} AS direct, list_filter(list_transform(p, lambda x: {_CITY}[x]), lambda x: x IS NOT NULL)[1] AS listed,
    list_filter({_list(G.CITY_COUNTRY)}, lambda c: contains(edged, '~' || replace(replace(c, ',', '~,~'), ' ', '~ ~') || '~'))[1] AS among,
    len(p) > 1 AND list_contains({_list((*G.STATES, G.DISTRICT))}, p[-1]) AS state, list_filter(list_transform(list_reverse(p), lambda x: {_known_sql('x')}), lambda x: x IS NOT NULL)[1] AS behind
  FROM (SELECT *, list_filter(list_transform(regexp_split_to_array(low, '[,/|·•]'), lambda x: trim(x)), lambda x: x <> '') AS p FROM (SELECT *, '~' || regexp_replace(low, '({_EDGE})', '~\\1~', 'g') || '~' AS edged FROM (SELECT *, lower(raw) AS low FROM (SELECT c_custkey, trim(regexp_replace(loc, '\\s+', ' ', 'g')) AS raw FROM ({_LOCATED}))))))""")  # fmt: skip
def p26_profile(t: Tables) -> DataFrame:
    """The country that a profile's location tells, and how surely."""
    return _rows(t, _LOCATED, "customer").withColumn("at", G.country_of(F.col("loc"))).select("c_custkey", "at.country", "at.confidence")


_GROUPED = ("Software, Apps,Mobile", "Artificial Intelligence (AI), Software", "Health Care , Biotechnology, Health Care", "Other", "", "Video,Sports,Design, Energy", "software", "Commerce and Shopping,Consumer Goods,Real Estate, Nothing", "Social Impact", "Privacy and Security, Data and Analytics, Events")
_CATEGORY = ("Machine Learning, SaaS", "Artificial Intelligence (AI), Artificial Intelligence", "Robotics, Industrial Robotics (heavy)", "", "Natural Language Processing,Big Data", "Neural Networks Of (x) , Deep Learning", "Marketplace", "MLOps tools, ML Ops", "Voice Recognition,Speech Recognition")
_INDUSTRY = ("Software", "Insurance", " Media ", "Other Business Products and Services", "", "Capital Markets/Institutions", "insurance", "Exploration, Production and Refining", "Agriculture")
_DUMP = f"SELECT id, CASE WHEN id % 29 > 0 THEN {_pick(_GROUPED, 'id')} END AS cg, CASE WHEN id % 31 > 0 THEN {_pick(_CATEGORY, 'id')} END AS cl, CASE WHEN id % 37 > 0 THEN {_pick(_INDUSTRY, 'id')} END AS ig FROM companies"
# a list's values once each, in order of their first place
_ONCE = "list_filter({0}, lambda x, k: x IS NOT NULL AND list_position({0}, x) = k)"


@plan("P29_category_map", f"SELECT id, {_ONCE.format('m')} AS verticals, CASE WHEN v IS NULL THEN [] ELSE [v] END AS industry FROM (SELECT id, list_transform(string_split(coalesce(cg, ''), ','), lambda g: {_MAP(FF.VERTICAL_OF_GROUP)}[trim(g)]) AS m, {_MAP(FF.VERTICAL_OF_INDUSTRY)}[trim(ig)] AS v FROM ({_DUMP}))", "companies")
def p29(t: Tables) -> DataFrame:
    return _rows(t, _DUMP, "companies").select("id", FF.verticals_of_groups(F.col("cg")).alias("verticals"), FF.vertical_of_industry(F.col("ig")).alias("industry"))


_TELLS = lambda c: f"len(list_filter({_list(FF.AI_CATEGORIES)}, lambda w: contains({c}, w))) > 0"


@plan("P31_category_score", f"""
SELECT id, CASE WHEN contains(lower(coalesce(cg, '')), 'artificial intelligence') THEN 0.9 WHEN {_TELLS("lower(coalesce(cl, ''))")} THEN 0.75 ELSE 0.6 END::DOUBLE AS score, {_ONCE.format('m')} AS tags
FROM (SELECT *, list_transform(string_split(lower(coalesce(cl, '')), ','), lambda c: coalesce({_MAP(FF.AI_TAGS)}[trim(c)], CASE WHEN {_TELLS('c')} THEN replace(replace(replace(trim(c), ' ', '-'), '(', ''), ')', '') END)) AS m FROM ({_DUMP}))""", "companies")  # fmt: skip
def p31(t: Tables) -> DataFrame:
    return _rows(t, _DUMP, "companies").select("id", FF.ai_score(F.col("cl"), F.col("cg")).alias("score"), FF.ai_tags(F.col("cl")).alias("tags"))


_DATES = ("2010-04-01", " 1899-01-01", "nan", "", "c. 2004", "2101", "1900", "201", "20245", "None")
_SIZES = ("51-100", "10000+", "1-10", "", "10,000", "null", "about 7", "many")
_AMOUNTS = ("0", "1.5", "", "12e3", "-0.0", "n/a", " 7 ", "1.5f", ".5", "1,000")
_FIELDS = f"SELECT p_partkey, CASE WHEN p_partkey % 23 > 0 THEN {_pick(_DATES, 'p_partkey')} END AS d, CASE WHEN p_partkey % 19 > 0 THEN {_pick(_SIZES, 'p_partkey')} END AS s, CASE WHEN p_partkey % 17 > 0 THEN CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS VARCHAR) ELSE {_pick(_AMOUNTS, 'p_partkey')} END END AS a FROM part"
_CLEANED = lambda c: f"CASE WHEN lower(trim({c})) NOT IN ('nan', 'none', 'null', '') THEN trim({c}) END"


@plan("P30_parsers", f"SELECT p_partkey, CASE WHEN y BETWEEN 1900 AND 2100 THEN y END AS year, low, nullif(v, 0) AS amount, v * 1000000 AS deal_size FROM (SELECT p_partkey, try_cast(nullif(regexp_extract({_CLEANED('d')}, '^([0-9]{{4}})', 1), '') AS INT) AS y, try_cast(nullif(regexp_extract({_CLEANED('s')}, '([0-9]+)', 1), '') AS BIGINT) AS low, try_cast(a AS DOUBLE) AS v FROM ({_FIELDS}))")
def p30(t: Tables) -> DataFrame:
    d, s, a = F.col("d"), F.col("s"), F.col("a")
    return _rows(t, _FIELDS, "part").select("p_partkey", FF.leading_year(d).alias("year"), FF.least_employees(s).alias("low"), FF.amount(a).alias("amount"), FF.deal_size(a).alias("deal_size"))


_NAMED = ("Berlin", "", "St. Louis (MO)", "new york", "A", "Zürich")
_HEADS = ("Founded 1999, 2020 2021-2031 in BERLIN. ", "American swiss-made U.S.based, U.S. firm ", "From ST. LOUIS (mo) in germany, 1799 x1999 1899", "The Bay Area, Silicon  Valley and silicon valley ", "us-based uk-based New York newyork ", "zürich 20250 2029 dutchman Dutch ")
_ASKED = f"SELECT doc_id, CASE WHEN doc_id % 13 > 0 THEN concat({_pick(_HEADS, 'doc_id')}, text) END AS text, CASE WHEN doc_id % 7 > 0 THEN {_pick(_NAMED, 'doc_id')} END AS city, CASE doc_id % 3 WHEN 0 THEN 'Germany' WHEN 1 THEN '' END AS country FROM documents"


def _twice(text: str, words: str, mask: str) -> str:
    """Whole words masked; a second time, as neighbours share the character between them."""
    for _ in range(2):
        text = f"regexp_replace({text}, '(?i)(^|{_EDGE})({words})($|{_EDGE})', '\\1{mask}\\3', 'g')"
    return text


_YEARLESS = _twice("coalesce(text, '')", "1[89][0-9]{2}|20[0-2][0-9]", "[YEAR]")
_PLACELESS = f"CASE WHEN {{1}} <> '' THEN regexp_replace({{0}}, '(?i)' || regexp_escape({{1}}), '[PLACE]', 'g') ELSE {{0}} END"
# u.s. ends in a dot, so its edge is a letter
_DEMONYMLESS = _twice("regexp_replace(t, '(?i)\\bu\\.s\\.\\b', '[PLACE]', 'g')", "|".join(w for w in K.DEMONYMS if w != "u.s."), "[PLACE]")


@plan("P35_scrub", f"SELECT doc_id, sha256({_DEMONYMLESS}) AS masked_sha256 FROM (SELECT doc_id, {_PLACELESS.format('t', 'country')} AS t FROM (SELECT doc_id, country, {_PLACELESS.format('t', 'city')} AS t FROM (SELECT *, {_YEARLESS} AS t FROM ({_ASKED}))))")
def p35(t: Tables) -> DataFrame:
    """Digests of texts without years, their own places and words that tell a country."""
    return _rows(t, _ASKED, "documents").select("doc_id", F.sha2(K.scrub(F.col("text"), F.col("city"), F.col("country")), 256).alias("masked_sha256"))


PLACES = tuple(sorted({p.lower() for p in (*G.CITY_COUNTRY, *G.POSITIONS, *G.US_CITIES, *L.COUNTRIES, *K.DEMONYMS)} - {"us", "la", "u.s.", "washington d.c."}))


@plan("P35_mask_places", f"SELECT doc_id, sha256({_twice('text', '|'.join(sorted((p.replace('.', '[.]') for p in PLACES), key=lambda p: (-len(p), p))), '[PLACE]')}) AS masked_sha256 FROM ({_ASKED})")
def p35_places(t: Tables) -> DataFrame:
    """Digests of texts without any place of the gazetteer, by one automaton."""
    return _rows(t, _ASKED, "documents").select("doc_id", F.sha2(K.mask_places(F.col("text"), PLACES), 256).alias("masked_sha256"))


_ANSWERS = ("2010", "2010.0", " Unknown ", "N/A", "-", "1-10", "Berlin", "2040.0", "1799", "", "not stated", "2039", "?", "2010.00")
_ANSWERED = f"SELECT id, CASE WHEN id % 23 > 0 THEN {_pick(_ANSWERS, 'id')} END AS a FROM companies"


@plan("P35_answered", f"SELECT id, CASE WHEN NOT list_contains({_list(K.DECLINED)}, v) THEN CASE WHEN regexp_full_match(v, '(1[89][0-9]{{2}}|20[0-3][0-9])(\\.0)?') THEN left(v, 4) ELSE v END END AS answer FROM (SELECT id, lower(trim(a)) AS v FROM ({_ANSWERED}))", "companies")
def p35_answered(t: Tables) -> DataFrame:
    return _rows(t, _ANSWERED, "companies").select("id", K.answered(F.col("a")).alias("answer"))


_ENDINGS = ("", " View More", " /page/2", " ?page = 3", " &P=4", " /p/x", " ?offset=20", " &cursor=", " Pagination", " page 2 of 9", " 1–20 of 90", " 1 - 20 of 90", " pages 2 of 9", " older posts")
_LISTED = f"""SELECT page_id, concat(translate(url, '0123456789', 'xxxxxxxxxx'), {_pick(_ENDINGS, 'page_id')}) AS body, page_id % 5 > 0 AS is_good, 'fine' AS reason, page_id % 27 AS record_count, page_id % 17 = 0 AS own_scraper, CASE WHEN page_id % 3 > 0 THEN page_id % 8 ELSE 0 END AS got,
  CASE page_id % 4 WHEN 0 THEN 'easy_candidate' WHEN 1 THEN 'challenging' WHEN 2 THEN 'dead' END AS probe_result, CASE WHEN page_id % 11 > 0 THEN 'HTTP 200' END AS probe_reason FROM pages"""
_MORE = "|".join(R.MORE_PAGES).replace(r"\s", r"[\s\p{Z}]")


@plan("P36_escalation", f"""
SELECT page_id, more, is_good AND NOT few AS is_good, CASE WHEN few THEN reason || ' | Escalation: ' || record_count || ' < 20 while pagination/load-more signals present (likely partial list) — use agent.' ELSE reason END AS reason
FROM (SELECT *, is_good AND record_count < 20 AND more AS few FROM (SELECT *, regexp_matches(body, {_text('(?i)' + _MORE)}) AS more FROM ({_LISTED})))""")
def p36_escalation(t: Tables) -> DataFrame:
    rows = _rows(t, _LISTED, "pages").withColumn("more", R.more_pages(F.col("body")))
    return rows.withColumn("v", R.escalated(*map(F.col, ("is_good", "reason", "record_count", "more")))).select("page_id", "more", "v.is_good", "v.reason")


@plan("P36_scrapeability", f"""
SELECT page_id, CASE WHEN own_scraper THEN 'easy' WHEN got > 5 THEN 'agentic' WHEN got > 0 THEN 'challenging' WHEN probe_result = 'easy_candidate' THEN 'agentic' ELSE 'challenging' END AS level,
  CASE WHEN own_scraper THEN 'dedicated scraper (API / HTML / parquet)' WHEN got > 5 THEN 'AI agent extracted ' || got || ' records' WHEN got > 0 THEN 'AI agent only extracted ' || got || ' record(s) — limited or JS-heavy'
    WHEN probe_result = 'easy_candidate' THEN 'not yet scraped — HTTP probe: accessible (' || coalesce(probe_reason, '') || ')' WHEN probe_result = 'challenging' THEN 'HTTP probe: ' || coalesce(probe_reason, '') ELSE 'no successful extraction recorded' END AS reason FROM ({_LISTED})""")
def p36_scrapeability(t: Tables) -> DataFrame:
    rows = _rows(t, _LISTED, "pages").withColumn("v", R.scrapeability(*map(F.col, ("own_scraper", "got", "probe_result", "probe_reason"))))
    return rows.select("page_id", "v.level", "v.reason")


_CITIES = ("Berlin", "paris", "SF", "Atlantis", "", "TOKYO", "boston", "St. Louis", " Ann Arbor ", "Washington D.C.", "Lima", "nyc")
_COUNTRIES = ("Germany", "united states", "US", "us ", "", "The USA", "UK", "Mordor", "korea")
_SEATED = f"SELECT *, CASE WHEN id % 23 > 0 THEN {_pick(_CITIES, 'id')} END AS city, CASE WHEN id % 19 > 0 THEN {_pick(_COUNTRIES, 'id')} END AS land FROM companies"
_AT = lambda table: "(VALUES " + ", ".join(f"({k}, {_text(name)}, {lat}::DOUBLE, {lon}::DOUBLE)" for k, (name, (lat, lon)) in enumerate(table.items())) + ") g(k, name, latitude, longitude)"


@plan("P39_geocode", f"""
SELECT id, arg_min(latitude, rank) AS latitude, arg_min(longitude, rank) AS longitude FROM (SELECT id, latitude, longitude, 1000 * (CASE WHEN g.name = city THEN 0 WHEN g.name = land THEN 1 WHEN lower(g.name) = lower(city) THEN 2 ELSE 3 END) + k AS rank
  FROM ({_SEATED}) LEFT JOIN {_AT(G.POSITIONS)} ON lower(g.name) = lower(city) OR lower(g.name) = lower(land)) GROUP BY 1""", "companies")  # fmt: skip
def p39(t: Tables) -> DataFrame:
    return _rows(t, _SEATED, "companies").withColumn("at", G.position_of(F.col("land"), F.col("city"))).select("id", "at.latitude", "at.longitude")


@plan("D17_place_totals", f"""
SELECT city, latitude, longitude, count(*) AS n, round(avg(CASE WHEN {AI} THEN 1 ELSE 0 END), 9) AS ai_share FROM ({_SEATED}) JOIN {_AT(G.US_CITIES)} ON g.name = trim(lower(city))
WHERE regexp_matches(lower(land), 'united states|usa|^us$') GROUP BY 1, 2, 3 ORDER BY n DESC, city, latitude, longitude LIMIT 100""", "companies")  # fmt: skip
def d17(t: Tables) -> DataFrame:
    """The hundred largest cities of the US as they are written, with position, firms and the share of AI firms."""
    rows = _rows(t, _SEATED, "companies").withColumn("at", G.us_position_of(F.col("land"), F.col("city"))).filter("at IS NOT NULL")
    cells = rows.groupBy("city", "at.latitude", "at.longitude").agg(F.count("*").alias("n"), F.round(F.avg(F.when(P.is_ai(), 1).otherwise(0)), 9).alias("ai_share"))
    return cells.orderBy(F.desc("n"), "city", "latitude", "longitude").limit(100)


_FIRMS = """SELECT id, CASE WHEN verification_status = 'emerging_github' THEN 'hidden' ELSE 'published' END AS bucket, CASE WHEN id % 7 < 4 THEN 'mapped' WHEN id % 7 < 6 THEN 'pending' ELSE 'category_mapped' END AS status,
  CASE WHEN segment = 'BUILDING' THEN 'healthcare' WHEN segment <> 'FURNITURE' THEN lower(segment) END AS ai_application, CASE WHEN id % 3 = 1 THEN 'vision' WHEN id % 3 = 2 THEN 'nlp' WHEN id % 2 = 1 THEN 'other' END AS ai_subfield,
  CASE WHEN id % 7 IN (4, 5) THEN 'Pending enrichment' WHEN id % 3 = 1 AND id % 11 < 7 THEN segment WHEN segment = 'BUILDING' THEN 'Healthcare' ELSE region END AS domain, CASE WHEN id % 13 < 5 THEN 'Generation' WHEN id % 13 < 10 THEN 'Detection' END AS capability,
  concat('label ', CAST(id % 5 AS VARCHAR)) AS label, CAST(id % 12 AS INT) AS cluster FROM companies"""
_MODE = lambda c: f"(SELECT ai_application, ai_subfield, arg_min(v, (-n, v)) AS {c}, max(n) AS most, sum(n) AS total FROM (SELECT ai_application, ai_subfield, {c} AS v, count(*) AS n FROM taught WHERE {c} IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2)"


@plan("M21_taxonomy_assembly", f"""
WITH firms AS (SELECT id, bucket, CASE WHEN again THEN 'pending' ELSE status END AS status, ai_application, ai_subfield, CASE WHEN again THEN 'Pending enrichment' ELSE domain END AS domain, CASE WHEN again THEN 'Other' ELSE capability END AS capability,
    CASE WHEN again THEN coalesce(ai_subfield, ai_application, 'unclassified') ELSE label END AS label, CASE WHEN again THEN -1 ELSE cluster END AS cluster FROM (SELECT *, status = 'category_mapped' AS again FROM ({_FIRMS}))),
  taught AS (SELECT * FROM firms WHERE bucket = 'hidden' AND status = 'mapped' AND ai_subfield <> 'other' AND ai_application IS NOT NULL),
  good AS (SELECT d.ai_application, d.ai_subfield, domain, capability, label, cluster FROM {_MODE('domain')} d LEFT JOIN {_MODE('capability')} USING (ai_application, ai_subfield) JOIN {_MODE('label')} USING (ai_application, ai_subfield) JOIN {_MODE('cluster')} USING (ai_application, ai_subfield)
    WHERE d.most / d.total >= 0.55 AND d.total >= 15),
  health AS (SELECT * FROM firms WHERE bucket = 'hidden' AND status = 'mapped' AND domain = 'Healthcare'),
  largest AS (SELECT arg_min(cluster, (-n, cluster)) AS cluster FROM (SELECT cluster, count(*) AS n FROM health GROUP BY 1)),
  named AS (SELECT arg_min(label, (-n, label)) AS label FROM (SELECT label, count(*) AS n FROM health WHERE cluster = (SELECT cluster FROM largest) GROUP BY 1)),
  met AS (SELECT f.*, g.domain AS d, g.capability AS c, g.label AS l, g.cluster AS k, f.status = 'pending' AND g.domain IS NOT NULL AS told,
    f.status = 'pending' AND g.domain IS NULL AND f.ai_application = 'healthcare' AND (SELECT cluster FROM largest) IS NOT NULL AS ill FROM firms f LEFT JOIN good g ON f.ai_application = g.ai_application AND f.ai_subfield = g.ai_subfield)
SELECT id, bucket, ai_application, ai_subfield, CASE WHEN told OR ill THEN 'category_mapped' ELSE status END AS status, CASE WHEN told THEN d WHEN ill THEN 'Healthcare' ELSE domain END AS domain, CASE WHEN told THEN c WHEN ill THEN 'Other' ELSE capability END AS capability,
  CASE WHEN told THEN l WHEN ill THEN (SELECT label FROM named) ELSE label END AS label, CASE WHEN told THEN k WHEN ill THEN (SELECT cluster FROM largest) ELSE cluster END AS cluster FROM met""", "companies")  # fmt: skip
def m21(t: Tables) -> DataFrame:
    return X.promote_pending(_rows(t, _FIRMS, "companies"))


_OPENINGS = (
    "Which AI sectors are growing?", "promo firms in nation_4", "Are STANDARD firms hidden in Tokyo?", "firms outside the US, nation_7", "fastest-growing medium firms", "Top 10 categories in paris", "hot firms", "What is not in Pitchbook", "nothing here",
    "large-scale x, boston", "on sale in Lima", "promotional nation_40", "what  ai industries in NATION_1", "small", "Atlantis non-US hidden growth", "bargains",
)
_QUESTIONS = f"SELECT conv_id, turn, CASE WHEN conv_id % 19 > 0 THEN concat({_pick(_OPENINGS, '(conv_id + turn)')}, ' ', coalesce(text, '')) END AS q FROM conversations"
_WORDS = {"PROMO": ["on sale", "bargains"]}
_MARKED = lambda v: f"(chr(1) || regexp_replace({v}, '([^a-z0-9])', chr(1) || '\\1' || chr(1), 'g') || chr(1))"
_SAID = lambda words: f"len(list_filter({_list(words)}, lambda w: contains(ql, w))) > 0"


@plan("D52_scope_resolver", f"""
WITH tags AS (SELECT tag, count(*) AS n FROM firm_tags JOIN companies ON id = company_id WHERE {AI} GROUP BY 1 HAVING count(*) >= 60),
  tagged AS (SELECT list(tag ORDER BY n DESC, tag) AS tags FROM tags),
  cities AS (SELECT coalesce(list(city ORDER BY city), []) AS cities FROM (SELECT trim(city) AS city, count(*) AS n FROM ({_SEATED}) WHERE {AI} AND city <> '' GROUP BY city HAVING count(*) >= 40 ORDER BY n DESC, city LIMIT 120)),
  lands AS (SELECT coalesce(list(country ORDER BY country), []) AS lands FROM (SELECT country FROM companies WHERE {AI} GROUP BY 1 HAVING count(*) >= 20)),
  asked AS (SELECT conv_id, turn, ' ' || lower(trim(coalesce(q, ''))) || ' ' AS ql FROM ({_QUESTIONS})),
  met AS (SELECT *, regexp_matches(ql, {_text('|'.join(Q.RANKING))}) AS ranking, {_MARKED('ql')} AS edged, {_SAID(Q.ABROAD)} AS non_us, {_SAID(Q.HIDDEN)} AS hidden_only, {_SAID(Q.MOMENTUM)} AS moving FROM asked),
  found AS (SELECT *, CASE WHEN NOT ranking THEN list_filter(tags, lambda t: contains(edged, {_MARKED("lower(replace(t, '-', ' '))")}) OR contains(edged, {_MARKED('lower(t)')}) OR t = 'PROMO' AND (contains(edged, {_MARKED("'on sale'")}) OR contains(edged, {_MARKED("'bargains'")})))[1] END AS tag,
    list_filter(cities, lambda c: contains(edged, {_MARKED('lower(c)')}))[1] AS city, list_filter(lands, lambda c: contains(edged, {_MARKED('lower(c)')}))[1] AS land FROM met, tagged, cities, lands)
SELECT conv_id, turn, CASE WHEN ranking THEN 'momentum' WHEN non_us OR city IS NOT NULL OR land IS NOT NULL THEN 'place' WHEN tag IS NOT NULL THEN 'category' WHEN hidden_only THEN 'hidden' WHEN moving THEN 'momentum' ELSE 'overview' END AS kind,
  tag, city, CASE WHEN city IS NULL AND NOT non_us THEN land END AS country, non_us, hidden_only, ranking FROM found""", "companies", "firm_tags")  # fmt: skip
def d52(t: Tables) -> DataFrame:
    """What the turns of conversations ask for, with the tags, cities and countries of many firms as vocabulary."""
    firms = _rows(t, _SEATED, "companies").filter(P.is_ai())
    many = lambda rows, key, least: rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    tags = many(t.firm_tags.join(firms.select(F.col("id").alias("company_id")), "company_id"), "tag", 60)
    tags = tags.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("tag").alias("name"), Q.needles(F.col("tag"), Q.SYNONYMS | _WORDS).alias("needles")))).alias("tags"))
    places = lambda rows, name: rows.agg(F.array_sort(F.collect_list(F.struct(F.trim(name).alias("name"), Q.place_needle(F.trim(name)).alias("needle")))).alias(name))
    cities = places(many(firms.filter("city <> ''"), "city", 40).orderBy(F.desc("n"), "city").limit(120), "city")
    countries = places(many(firms, "country", 20), "country")
    # three rows, of as many values as tags, cities and countries of many firms there are
    vocabulary = tags.join(F.broadcast(cities), how="cross").join(F.broadcast(countries), how="cross")
    rows = _rows(t, _QUESTIONS, "conversations").join(F.broadcast(vocabulary), how="cross")
    return rows.withColumn("s", Q.scope_of(F.col("q"), F.col("tags"), F.col("city"), F.col("country"))).select("conv_id", "turn", "s.*")
