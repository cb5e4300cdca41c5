"""Text, domain and name functions as Columns. Patterns are kept as they are, including stems that match no inflection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ventura.functions.places import registrable

#: Hosts that are never a firm's own domain.
SHARED_HOSTS = (
    "github.com", "github.io", "gitlab.com", "bitbucket.org",
    "readthedocs.io", "readthedocs.org", "rtfd.io",
    "docs.rs", "pkg.go.dev", "pypi.org", "npmjs.com",
    "medium.com", "dev.to", "substack.com", "hashnode.dev",
    "twitter.com", "x.com", "linkedin.com", "facebook.com",
    "youtube.com", "reddit.com", "discord.gg", "discord.com",
    "t.me", "telegram.org", "slack.com",
    "arxiv.org", "papers.ssrn.com", "scholar.google.com",
    "huggingface.co", "kaggle.com",
    "producthunt.com", "theresanaiforthat.com",
    "notion.so", "notion.site",
    "google.com", "amazonaws.com", "azure.com",
    "wikipedia.org", "stackoverflow.com",
)
#: Words cut out of a firm's name.
NAME_SUFFIXES = (
    "inc", "incorporated", "llc", "ltd", "limited", "co", "corp", "corporation",
    "labs", "lab", "ai", "io", "tech", "technologies", "technology", "software",
    "solutions", "systems", "platform", "group", "holding", "holdings",
    "gmbh", "sa", "sas", "sarl", "bv", "pty", "pte",
)
#: The shorter list of the conservative variant.
LEGAL_SUFFIXES = ("inc", "llc", "ltd", "limited", "corp", "corporation", "gmbh", "plc", "sa", "bv")


def host(url: Column) -> Column:
    """Host of a URL with or without a scheme, lower-cased, without user, port and www."""
    out = F.regexp_replace(F.lower(F.trim(url)), r"^https?://", "")
    out = F.regexp_extract(out, r"^([^/?#]*)", 1)
    out = F.regexp_replace(F.regexp_replace(out, r"^.*@", ""), r":.*$", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(out, r"^\.+|\.+$", ""), r"^www\.", ""), F.lit(""))


def canonicalize_domain(url: Column) -> Column:
    """Registrable domain of a URL or host, the host itself for addresses, single labels and public suffixes; null if there is none."""
    return registrable(host(url))


def is_product_domain(domain: Column) -> Column:
    """False for shared hosts, their subdomains, addresses, the local machine and empty text."""
    shared = "|".join(s.replace(".", r"\.") for s in SHARED_HOSTS)
    name = F.lower(domain)
    bad = name.rlike(rf"^(.*\.)?({shared})$") | name.rlike(r"^\d+\.\d+\.\d+\.\d+$") | name.startswith("localhost") | name.startswith("127.") | (name == "")
    return F.coalesce(~bad, F.lit(False))


#: Characters that end a URL in running text, and those cut from its end.
URL_IN_TEXT = r"(?i)(https?://[^\s\)\]\}>\"'`,;]+)"
URL_TAIL = ".)],;:!?'\""


def extract_domains(text: Column) -> Column:
    """Distinct registrable domains of the http(s) URLs in a text, in order."""
    urls = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(URL_IN_TEXT), 1)
    return F.array_distinct(F.filter(F.transform(urls, lambda u: canonicalize_domain(F.rtrim(u, F.lit(URL_TAIL)))), lambda d: d.isNotNull()))


#: Words near which a text names the firm's own site.
SITE_WORDS = r"(?i)(website|homepage|app|demo|waitlist|pricing|product|try it|get started|sign up|launch)"


def homepage_domain(homepage: Column, blog: Column, text: Column) -> Column:
    """The first own domain of: the homepage, the blog, lines of the text with one of SITE_WORDS, the whole text."""
    own = lambda c: F.when(is_product_domain(c), c)
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(SITE_WORDS))
    near = F.flatten(F.transform(lines, extract_domains))
    first = lambda a: F.get(F.filter(a, is_product_domain), 0)
    return F.coalesce(own(canonicalize_domain(homepage)), own(canonicalize_domain(blog)), first(near), first(extract_domains(text)))


def simple_domain(url: Column) -> Column:
    """Scheme and www cut, everything from the first slash dropped."""
    return F.lower(F.split_part(F.regexp_replace(url, r"^(https?://)?(www\.)?", ""), F.lit("/"), F.lit(1)))


def normalize_company_name(name: Column, suffixes: tuple[str, ...] = NAME_SUFFIXES) -> Column:
    """Lower case; punctuation but hyphens, suffix words and single characters (between word edges) become spaces; spaces squeezed; empty is null."""
    out = F.regexp_replace(F.lower(F.trim(name)), r"(?U)[^\w\s\-]", " ")
    out = F.regexp_replace(out, rf"(?U)\b({'|'.join(suffixes)})\b\.?", " ")
    out = F.regexp_replace(out, r"(?U)\b\w\b", " ")
    out = F.trim(F.regexp_replace(out, r"(?U)\s+", " "))
    return F.nullif(F.trim(F.trim(out, F.lit("-"))), F.lit(""))


def entity_key(domain: Column, name: Column) -> Column:
    """``domain:...`` if there is a domain, else ``name:...`` of the normalised name."""
    return F.coalesce(F.concat(F.lit("domain:"), F.nullif(F.lower(F.trim(domain)), F.lit(""))), F.concat(F.lit("name:"), normalize_company_name(name)))


#: Topics and text patterns; stems with a trailing word edge match no inflection (``fine[- ]?tun`` never matches "fine-tuning").
STRONG_TOPICS = (
    "llm", "rag", "agents", "generative-ai", "generative_ai",
    "large-language-model", "large-language-models",
    "langchain", "llamaindex", "autogen",
)
MODERATE_TOPICS = (
    "ai", "machine-learning", "deep-learning", "computer-vision",
    "nlp", "natural-language-processing", "neural-network",
    "reinforcement-learning", "speech-recognition",
    "transformer", "diffusion", "multimodal",
)
STRONG_WORDS = (
    r"fine[- ]?tun|inference|transformer|diffusion|multimodal|large language model|retrieval.augmented|rag pipeline|"
    r"vector.?database|embedding.?model|llm.?agent|text.?to.?image|speech.?to.?text|foundation model"
)
MODERATE_WORDS = (
    r"artificial intelligence|machine learning|deep learning|neural net|computer vision|natural language|object detection|image classification|"
    r"sentiment analysis|recommendation engine|model training|model serving|mlops|pytorch|tensorflow|jax|hugging\s?face|"
    r"generative ai|gen ai|ai.powered|ai-driven|ai-enabled|predictive analytics|data science"
)
NAME_WORDS = r"AI|ML|LLM|GPT|NLP|AGI|artificial intelligence|machine learning|deep learning|neural|generative"
STARTUP_WORDS = (
    r"waitlist|pricing|book a demo|request demo|customers|enterprise|saas|api key|free trial|sign up|get started|early access|beta access|"
    r"backed by|funded by|raised|series [a-d]|seed round|our platform|our product|we help|we build"
)
COMMERCIAL_WORDS = (
    r"pricing|contact us|enterprise|cloud|api|signup|sign up|waitlist|book a demo|request demo|free trial|get started|early access|beta access|"
    r"our platform|our product|we help|we build|backed by|funded by|raised|series [a-d]|seed round|customers|saas|managed service|hosted|on-prem"
)
PRODUCT_WORDS = r"platform|product|api|service|tool|solution"


def has_words(text: Column, words: str) -> Column:
    """Whether one of the words stands between word edges in the text, in any case; false for null."""
    return F.coalesce(text.rlike(rf"(?i)\b({words})\b"), F.lit(False))


def _points(*tests: tuple[Column, float]) -> Column:
    return sum((F.when(F.coalesce(t, F.lit(False)), p).otherwise(0.0) for t, p in tests), F.lit(0.0))


def _topics(topics: Column) -> Column:
    return F.transform(F.coalesce(topics, F.array().cast("array<string>")), lambda t: F.lower(F.trim(t)))


def ai_score(topics: Column, text: Column, tagged: Column) -> Column:
    """0.3 strong topic, 0.2 moderate topic, 0.2 strong text, 0.1 moderate text, 0.2 database tag; at most 1."""
    among = lambda names: F.arrays_overlap(_topics(topics), F.array(*map(F.lit, names)))
    return F.least(F.lit(1.0), _points((among(STRONG_TOPICS), 0.3), (among(MODERATE_TOPICS), 0.2), (has_words(text, STRONG_WORDS), 0.2), (has_words(text, MODERATE_WORDS), 0.1), (tagged, 0.2)))


def ai_mentioned(name: Column, text: Column) -> Column:
    """A name with one of NAME_WORDS, or a text with a strong or a moderate word."""
    return has_words(name, NAME_WORDS) | has_words(text, STRONG_WORDS) | has_words(text, MODERATE_WORDS)


def startup_score(domain: Column, owner_type: Column, text: Column, funded: Column) -> Column:
    """0.4 own domain, 0.2 organisation, 0.2 text signal, 0.2 financing or database record; at most 1."""
    return F.least(F.lit(1.0), _points((is_product_domain(domain), 0.4), (F.lower(owner_type) == "organization", 0.2), (has_words(text, STARTUP_WORDS), 0.2), (funded, 0.2)))


def startup_likelihood(domain: Column, owner_type: Column, has_site: Column, description: Column, text: Column, recent: Column) -> Column:
    """0.3 own domain, 0.15 organisation, 0.1 site, 0.25 three commercial words or 0.15 one, 0.1 recent push, 0.1 product word in the description."""
    n = F.coalesce(F.regexp_count(text, F.lit(rf"(?i)\b({COMMERCIAL_WORDS})\b")), F.lit(0))
    score = _points((is_product_domain(domain), 0.3), (F.lower(owner_type) == "organization", 0.15), (has_site, 0.1), (n >= 3, 0.25), (n.between(1, 2), 0.15), (recent, 0.1), (has_words(description, PRODUCT_WORDS), 0.1))
    return F.round(F.least(F.lit(1.0), score), 4)


def ai_tags(topics: Column, text: Column) -> Column:
    """Sorted distinct topics that are listed, and the strong words of the text in lower case with hyphens for blanks."""
    listed = F.filter(_topics(topics), lambda t: t.isin(*STRONG_TOPICS, *MODERATE_TOPICS))
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?i)\b({STRONG_WORDS})\b"), 1)
    return F.array_sort(F.array_distinct(F.concat(listed, F.transform(found, lambda w: F.regexp_replace(F.lower(w), r"\s+", "-")))))


def visible_text(html: Column) -> Column:
    """HTML without scripts, styles, navigation, footers and vector graphics; tags to spaces, blanks squeezed."""
    out = F.regexp_replace(html, r"(?is)<(script|style|nav|footer|svg)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->|<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def token_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of the sets of white-space tokens; null if both are empty."""
    x, y = (F.array_distinct(F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda t: t != "")) for c in (a, b))
    return F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y)).cast("double"))


def batch_year(batch: Column) -> Column:
    """``W26`` and the like are 2026; else the first year of four digits; else null."""
    short = F.regexp_extract(batch, r"(?i)^[WSFX](\d{2})$", 1)
    full = F.regexp_extract(batch, r"((?:19|20)\d{2})", 1)
    return F.when(short != "", 2000 + short.try_cast("int")).otherwise(F.nullif(full, F.lit("")).try_cast("int"))


def tag_label(tag: Column) -> Column:
    return F.initcap(F.translate(F.lower(tag), "-_", "  "))
