"""Classification rules over text, checks of models' answers, and triage of failed sites."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ventura.functions.places import _bound
from ventura.session import ship

#: Subdomains and layers of repositories in order, the first whose words are met wins.
SUBDOMAINS = {
    "Agents": "agent|agents|agentic|multi.?agent|autonomous.?agent|tool.?use|function.?call|crew.?ai|autogen|langgraph|swarm|orchestrat|reason.?act",
    "RAG/Retrieval": "rag|retrieval.?augmented|vector.?database|vector.?store|knowledge.?base|semantic.?search|embedding.?search|chunk|retriev|llamaindex|langchain|rerank|document.?qa|pdf.?chat",
    "Model/Training": "fine.?tun|pre.?train|train|lora|qlora|rlhf|dpo|alignment|distill|quantiz|pruning|foundation.?model|large.?language|bert|gpt|llama|mistral|mixtral|gemma|phi|checkpoint|hyperparameter",
    "Inference/Serving": "inference|serving|deploy|vllm|tgi|triton|onnx|tensorrt|llm.?server|model.?server|batch.?inference|streaming|token.?per.?sec|endpoint|gpu.?optim",
    "Vision/OCR": "computer.?vision|image|object.?detect|segmentat|ocr|optical.?character|yolo|diffusion|stable.?diffusion|text.?to.?image|image.?gen|visual|multimodal|vlm",
    "Audio/Speech": "speech|audio|voice|asr|tts|text.?to.?speech|speech.?to.?text|whisper|transcri|music|sound|speaker",
    "Data/Scraping": "scrap|crawl|data.?pipeline|data.?extract|dataset|data.?collect|etl|synthetic.?data|annotation|label",
    "Eval/Observability": "eval|benchmark|observ|monitor|trac|prompt.?engineer|guardrail|safety|test|metric|leaderboard|langfuse|langsmith|phoenix|arize",
    "DevTools": "sdk|cli|api|framework|library|toolkit|plugin|extension|integration|wrapper|developer|devtool|open.?source|template|starter|boilerplate",
}
LAYERS = {
    "Agent": "agent|agentic|multi.?agent|autonomous|orchestrat|crew.?ai|autogen|langgraph|swarm",
    "Model": "model|llm|bert|gpt|llama|mistral|mixtral|foundation|pre.?train|fine.?tun|transformer|diffusion|lora|qlora",
    "Infra": "infra|inference|serving|deploy|gpu|cluster|kubernetes|docker|cloud|vllm|triton|tensorrt|endpoint|scale",
    "Data": "data|dataset|pipeline|etl|scrap|crawl|vector.?database|embedding.?store|annotation|label|synthetic",
    "Framework": "framework|library|sdk|toolkit|langchain|llamaindex|langfuse|pytorch|tensorflow|jax|hugging.?face",
    "App": "app|application|platform|product|saas|dashboard|frontend|demo|chatbot|chat|assistant|copilot|ui",
}
#: Fixed value: characters of a readme that are looked at.
README_LENGTH = 3000
#: Words that make a firm an AI firm, and words that leave it open.
AI_WORDS = (
    "artificial intelligence", "machine learning", "large language model", "llm",
    "generative ai", "generative", "gpt", "neural network", "deep learning", "nlp",
    "natural language processing", "computer vision", "data science", "autonomous",
    "robotics", "predictive", "recommendation engine", "transformer",
    "diffusion", "reinforcement learning", "rag", "retrieval augmented",
    "foundation model", "fine-tuning", "embeddings", "agentic", "ai agent",
    "ai-powered", "ai-driven", "ai assistant", "copilot", "chatbot",
)
TECH_WORDS = (
    "software", "saas", "platform", "api", "cloud", "data", "analytics",
    "automation", "developer", "infrastructure", "iot", "fintech", "healthtech",
    "biotech", "blockchain", "crypto", "web3", "mobile app", "marketplace",
    "no-code", "low-code", "devops",
)
#: Patterns of grant titles.
AI_TITLES = (
    r"artificial intelligence", r"\bai\b", r"\bai-\w", r"machine learning",
    r"deep learning", r"neural network", r"computer vision",
    r"natural language", r"\bllms?\b", r"large language model",
    r"generative (?:ai|model|adversarial|design)", r"foundation model",
    r"reinforcement learning", r"\bautonomous\b",
)
#: Terms of generative AI and how they are told.
GEN_AI = {
    "generative ai": r"generative ai|gen-?ai\b",
    "llm": r"\bllm\b|large language model",
    "gpt / chatgpt": r"\bgpt\b|chatgpt",
    "agents": r"\bai agent|agentic|autonomous agent",
    "copilot": r"co-?pilot",
    "transformer/diffusion": r"transformer model|diffusion model|stable diffusion",
    "foundation model": r"foundation model",
    "RAG/prompt": r"retrieval[- ]augmented|\brag\b|prompt engineering",
    "multimodal": r"multi-?modal",
    "openai/anthropic": r"openai|anthropic|hugging ?face",
}
#: What is cut out of descriptions, and phrases of grant abstracts (one strong or two weak ones).
CUT_URL = r"https?://\S+|www\.\S+|\b\S+\.com\S*|twitter\s+com|https\s+twitter"
CUT_ENTITY = r"\b(x2f|x27|x3d|x2d|x3a|x26|quot|amp|nbsp|gt|lt|apos|8217|8220|8221)\b"
CUT_BOILERPLATE = r"sbir|sttr|awardee|framework programme|participant sme|horizon 2020|\bh2020\b|hugging\s*face organization|\d+\s+followers|followers twitter|eu framework|project\s+20\d{2}|20\d{2}\s+project"
GRANT_STRONG = (
    "sbir", "sttr", "framework programme", "horizon 2020", "department of defense",
    "grant agreement", "cordis", "awardee", "defense award", "phase ii project",
    "european commission", "department of commerce", "commerce award",
    "department commerce", "project phase", "award project",
)
GRANT_WEAK = (
    "programme", " sme ", "phase i", "phase ii", "consortium", "work package",
    "deliverable", "project aim", "participant", "funded under", "this project",
    "the project", "sme instrument",
)
LEAST_CLEAN, LEAST_SHARE = 40, 0.4
#: Words of errors, by what they tell.
BLOCKED = ("403", "429", "forbidden", "rate limit", "blocked", "captcha", "cloudflare")
THIN = ("no content", "empty", "thin", "playwright", "render", "javascript required", "tavily returned")
UNPARSED = ("json", "parse", "decode", "invalid extraction", "validation")
SPENT = ("pagination", "budget", "max_calls", "exceeded")
#: What tells that a listing goes on, below how many records that matters, and up to how many a site is challenging.
MORE_PAGES = (
    "view more", "load more", "show more", "see more", "read more", "next page", "older posts", "newer posts", "previous page", "prev page", "pagination",
    r"[?&]page\s*=\s*\d+", r"/page/\d+", r"[?&]p\s*=\s*\d+", r"/p/\d+", r"[?&]offset\s*=\s*\d+", r"[?&]cursor\s*=", r"\bpage\s+\d+\s+of\s+\d+", r"\b\d+\s*[-–]\s*\d+\s+of\s+\d+",
)
FEW_RECORDS, CHALLENGING = 20, 5


def _blob(*parts: Column) -> Column:
    """Parts that are there, with blanks between."""
    return F.concat_ws(" ", *parts)


def _first_label(text: Column, rules: dict[str, str]) -> Column:
    out = F.lit("Other")
    for name, words in reversed(rules.items()):
        out = F.when(text.rlike(rf"(?iU)\b({words})\b"), name).otherwise(out)
    return out


def classify_repo(topics: Column, description: Column, readme: Column) -> Column:
    """struct(subdomain, layer) of a repository; ``Other`` where no rule's words are met or there is no text."""
    text = _blob(F.array_join(topics, " "), description, F.left(readme, F.lit(README_LENGTH)))
    return F.struct(_first_label(text, SUBDOMAINS).alias("subdomain"), _first_label(text, LAYERS).alias("layer"))


def _any_word(words: tuple[str, ...]) -> str:
    """One of the words, with neither a-z nor a digit beside it."""
    return rf"(?i)(?<![a-z0-9])(?:{'|'.join(re.escape(w) for w in words)})(?![a-z0-9])"


def classify_ai(name: Column, description: Column, tags: Column) -> Column:
    """struct(is_ai, confidence, source) by words alone: certain with an AI word or without any word of technology, else open."""
    text = _blob(*(F.when(c != "", c) for c in (name, description, tags)))
    verdict = lambda flag, sure, source: F.struct(F.lit(flag).alias("is_ai"), F.lit(sure).alias("confidence"), F.lit(source).alias("source"))
    hit = text.rlike(_any_word((*AI_WORDS, "ai")))
    return F.when(hit, verdict(True, 1.0, "keyword")).when(~text.rlike(_any_word(TECH_WORDS)), verdict(False, 1.0, "keyword")).otherwise(verdict(False, 0.5, "keyword_only"))


def looks_ai(title: Column) -> Column:
    return F.coalesce(title, F.lit("")).rlike(f"(?iU){'|'.join(AI_TITLES)}")


def gen_ai_terms(text: Column) -> Column:
    """Terms of generative AI in a text, in the list's order."""
    body = F.coalesce(text, F.lit(""))
    return F.array_compact(F.array(*(F.when(body.rlike(f"(?iU){p}"), term) for term, p in GEN_AI.items())))


def clean_description(text: Column) -> Column:
    """Entities turned to characters, addresses, left-over entity names and boilerplate to blanks, blanks squeezed."""
    out = F.coalesce(text, F.lit(""))
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(c))
    for pattern in (CUT_URL, CUT_ENTITY, CUT_BOILERPLATE):
        out = F.regexp_replace(out, f"(?iU){pattern}", " ")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def is_grant(text: Column) -> Column:
    """Whether a text is the abstract of a grant: a strong phrase, or two weak ones."""
    body = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    weak = sum((F.contains(body, F.lit(p)).cast("int") for p in GRANT_WEAK), F.lit(0))
    strong = F.lit(False)
    for p in GRANT_STRONG:
        strong = strong | F.contains(body, F.lit(p))
    return strong | (weak >= 2)


def keeps_text(raw: Column, clean: Column) -> Column:
    """Whether enough of a description is left, and it is no grant's."""
    return ~is_grant(clean) & (F.length(clean) >= LEAST_CLEAN) & (F.length(clean) / F.greatest(F.length(raw), F.lit(1)) >= LEAST_SHARE)


def failure_bucket(probe_error: Column, status_code: Column, parked: Column, reachable: Column, content_length: Column, on_topic: Column, runs: Column, last_records: Column, failures: Column, has_instruction: Column, *errors: Column) -> Column:
    """Why a site fails: the first rule that holds, from a dead site to one never tried."""
    blob = F.lower(F.concat_ws(" ", *errors))
    says = lambda words: blob.rlike("|".join(re.escape(w) for w in words))
    yes = lambda c: F.coalesce(c, F.lit(False))
    barred = yes(status_code.isin(403, 429))
    nothing = (runs > 0) & yes(last_records == 0) & yes(reachable)
    return (
        F.when(yes(probe_error == "dns_fail") | yes(parked) | (yes(status_code >= 400) & ~barred) | (yes(probe_error == "timeout") & (runs == 0)), "H_DEAD_SITE")
        .when(yes(reachable) & yes(content_length > 500) & ~yes(on_topic), "I_OFFTOPIC")
        .when(barred | says(BLOCKED), "C_HTTP_BLOCKED")
        .when(says(THIN), "B_ANTI_BOT_JS")
        .when(says(UNPARSED), "E_PARSE_FAIL")
        .when(says(SPENT), "F_PAGINATION")
        .when(nothing & yes(has_instruction) & (failures >= 2), "G_STRUCTURE_BROKEN")
        .when(nothing, "D_WRONG_URL")
        .when((runs == 0) & yes(reachable), "A_NEVER_TRIED")
        .otherwise("Z_UNKNOWN")
    )


def more_pages(text: Column) -> Column:
    """Whether a listing's text tells that it goes on: words, addresses of pages, or counts such as ``1-20 of 90``."""
    return F.coalesce(text, F.lit("")).rlike("(?iU)" + "|".join(MORE_PAGES))


def escalated(is_good: Column, reason: Column, record_count: Column, more: Column) -> Column:
    """struct(is_good, reason): a good answer of few records fails where more pages are told; others stay."""
    few = is_good & (record_count < FEW_RECORDS) & more
    told = F.concat(reason, F.lit(" | Escalation: "), record_count.cast("string"), F.lit(f" < {FEW_RECORDS} while pagination/load-more signals present (likely partial list) — use agent."))
    return F.when(few, F.struct(F.lit(False).alias("is_good"), told.alias("reason"))).otherwise(F.struct(is_good.alias("is_good"), reason.alias("reason")))


def scrapeability(own_scraper: Column, record_count: Column, probe_result: Column, probe_reason: Column) -> Column:
    """struct(level, reason) of a site: by its own scraper, then what an agent got, then the probe."""
    made = lambda level, *reason: F.struct(F.lit(level).alias("level"), F.concat(*reason).alias("reason"))
    count, why = record_count.cast("string"), F.coalesce(probe_reason, F.lit(""))
    return (
        F.when(own_scraper, made("easy", F.lit("dedicated scraper (API / HTML / parquet)")))
        .when(record_count > CHALLENGING, made("agentic", F.lit("AI agent extracted "), count, F.lit(" records")))
        .when(record_count > 0, made("challenging", F.lit("AI agent only extracted "), count, F.lit(" record(s) — limited or JS-heavy")))
        .when(probe_result == "easy_candidate", made("agentic", F.lit("not yet scraped — HTTP probe: accessible ("), why, F.lit(")")))
        .when(probe_result == "challenging", made("challenging", F.lit("HTTP probe: "), why))
        .otherwise(made("challenging", F.lit("no successful extraction recorded")))
    )


_FENCE = re.compile(r"```(?:json)?\s*([\s\S]*?)\s*```")
_BRACKET = re.compile(r'["{}\[\]]')
_STRING_END = re.compile(r'(?:[^"\\]|\\[\s\S])*"')


def balanced_slice(text: str) -> str | None:
    """The first object or array of a text, whole; brackets in strings don't count. None if it never closes or closes wrongly.

    Jumps from bracket to bracket and over whole strings, so it reads each character once.
    """
    opened = re.search(r"[{\[]", text)
    if not opened:
        return None
    stack, at = [], opened.start()
    while found := _BRACKET.search(text, at):
        c, at = found[0], found.end()
        if c == '"':
            closed = _STRING_END.match(text, at)
            if not closed:
                return None
            at = closed.end()
        elif c in "{[":
            stack.append(c)
        elif stack.pop() + c not in ("{}", "[]"):
            return None
        elif not stack:
            return text[opened.start() : at]
    return None


def json_of_answer(text: str | None) -> str | None:
    """The JSON in a model's answer: what a fence holds, else the first balanced slice, else the whole; None if none is JSON."""
    text = (text or "").strip()
    fenced = _FENCE.search(text)
    for candidate in (fenced[1].strip() if fenced else balanced_slice(text), text):
        if candidate:
            try:
                return json.dumps(json.loads(candidate))
            except ValueError:
                continue
    return None


def answer_json(answer: Column) -> Column:
    """``json_of_answer`` in Arrow batches."""
    ship(SparkSession.active())

    @F.pandas_udf("string")
    def parsed(texts: pd.Series) -> pd.Series:
        return texts.map(json_of_answer)

    return parsed(answer)


def aligned_verdicts(answer: Column, ids: Column) -> Column:
    """array of (id, is_ai) from a batch's answer ``{"verdicts": [{"index", "is_ai"}]}``: verdict i is of the i-th id, the last of
    equal indexes counts, ids without a verdict are left out, and so are verdicts without an id."""
    verdicts = F.from_json(answer, "verdicts array<struct<index: string, is_ai: boolean>>")["verdicts"]
    good = F.filter(F.coalesce(verdicts, F.array()), lambda v: v["index"].try_cast("int").isNotNull())
    placed = F.array_sort(F.transform(good, lambda v, k: F.struct(v["index"].try_cast("int").alias("index"), k.alias("k"), F.coalesce(v["is_ai"], F.lit(False)).alias("is_ai"))))
    # the last of equal indexes, so that the map has each key once whatever the session does with equal ones
    last = _bound(placed, lambda rows: F.filter(rows, lambda v, k: ~v["index"].eqNullSafe(F.get(rows, k + 1)["index"])))
    keyed = F.map_from_entries(F.transform(last, lambda v: F.struct(v["index"], v["is_ai"])))
    made = F.transform(ids, lambda i, k: F.struct(i.alias("id"), F.try_element_at(keyed, k).alias("is_ai")))
    return F.filter(made, lambda r: r["is_ai"].isNotNull())


#: Numbers in prose, how far one may be from a fact, and years, which are none.
NUMBER, TOLERANCE, FIRST_YEAR, LAST_YEAR = r"(-?\d[\d,]*(?:\.\d+)?)", 0.051, 1900, 2100


def numbers_check_out(text: Column, facts: Column) -> Column:
    """Whether every number of a text but years is within TOLERANCE of a fact (array of double) or of a rounding of one.

    Each fact allows itself, its size, and both to one decimal and to none. Numbers look up their neighbours in the sorted array by
    binary search.
    """
    allowed = F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(facts, lambda f: f.isNotNull() & ~F.isnan(f)), lambda f: F.array(f, F.abs(f), F.bround(f, 1), F.bround(f, 0), F.bround(F.abs(f), 1), F.bround(F.abs(f), 0))))))
    # steps of the search: as many as the array's size has bits
    steps = F.sequence(F.lit(1), F.length(F.bin(F.size(allowed).cast("long"))))

    def near(v: Column) -> Column:
        start = F.struct(F.lit(0).alias("lo"), F.size(allowed).alias("hi"))
        middle = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        step = lambda s, _: F.when(s["lo"] >= s["hi"], s).when(F.get(allowed, middle(s)) < v, F.struct((middle(s) + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), middle(s).alias("hi")))
        at = F.aggregate(steps, start, step)["lo"]  # the first fact that isn't below v
        close = lambda a: F.coalesce(F.abs(a - v) < TOLERANCE, F.lit(False))
        return close(F.get(allowed, at)) | close(F.get(allowed, at - 1))

    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), 1), lambda n: F.replace(n, F.lit(","), F.lit("")).try_cast("double"))
    claims = F.filter(found, lambda v: v.isNotNull() & ~((v == F.floor(v)) & v.between(FIRST_YEAR, LAST_YEAR)))
    return F.forall(claims, near)
