"""What a question asks for: a tag, a place, hidden firms, momentum or a ranking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ventura.functions.gazetteer import _tidy

#: Words for a tag beside its own name.
SYNONYMS = {
    "agents": ["agent", "agentic", "ai agents", "autonomous agents"],
    "generative-ai": ["generative", "genai", "gen ai", "image generation", "text to image"],
    "llm": ["language model", "language models", "foundation model", "gpt"],
    "nlp": ["natural language", "text analysis"],
    "computer-vision": ["vision", "image recognition", "visual"],
    "robotics": ["robot", "robots", "robotic", "humanoid"],
    "autonomous-vehicles": ["self driving", "self-driving", "autonomous driving", "av"],
    "rag": ["retrieval augmented", "retrieval-augmented", "vector search"],
    "predictive-analytics": ["forecasting", "prediction"],
    "speech-recognition": ["speech", "voice", "audio"],
    "rpa": ["process automation", "workflow automation"],
    "big-data": ["data infrastructure", "data platform"],
}
#: Words anywhere in a question, and patterns of questions across categories.
HIDDEN = ("hidden", "crunchbase", "pitchbook", "commercial database", "not in", "before they", "undiscovered", "invisible", "unregistered")
MOMENTUM = ("fastest", "growing", "growth", "accelerat", "rising", "momentum", "trend", "hot", "emerging", "this week", "this month", "changed")
ABROAD = ("outside the us", "outside the u.s", "outside the united states", "non-us", "outside america", "rest of the world", "internationally")
RANKING = (
    r"\bwhich\s+(?:ai\s+)?(?:categor|sector|vertical|area|space|industr|field)",
    r"\bwhat\s+(?:ai\s+)?(?:categor|sector|vertical|area|space|industr|field)",
    r"\bfastest[- ]growing\b",
    r"\btop\s+\d*\s*(?:categor|sector|vertical|industr)",
)
_EDGE = "\u0001"


def _edged(low: Column) -> Column:
    """With marks around every character but a-z and 0-9, and at both ends, so that whole words are found by ``contains``."""
    return F.concat(F.lit(_EDGE), F.regexp_replace(low, "([^a-z0-9])", f"{_EDGE}$1{_EDGE}"), F.lit(_EDGE))


def needles(tag: Column, synonyms: dict[str, list[str]] = SYNONYMS) -> Column:
    """What tells a tag in a question: its name with and without hyphens, and its synonyms."""
    known = F.create_map(*(x for k, v in synonyms.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    own = F.array(F.replace(tag, F.lit("-"), F.lit(" ")), tag)
    return F.transform(F.concat(own, F.coalesce(F.try_element_at(known, tag), F.array().cast("array<string>"))), lambda w: _edged(F.lower(w)))


def place_needle(place: Column) -> Column:
    return _edged(F.lower(place))


def scope_of(question: Column, tags: Column, cities: Column, countries: Column) -> Column:
    """struct(kind, tag, city, country, non_us, hidden_only, ranking) of a question.

    ``tags`` is an array of struct(name, needles) in order of precedence, ``cities`` and ``countries`` arrays of struct(name, needle);
    the first that is met wins, a city before any country. A question across categories has no tag. Null and empty
    questions ask for an overview.
    """
    low = F.concat(F.lit(" "), F.lower(_tidy(F.coalesce(question, F.lit("")))), F.lit(" "))
    says = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    ranking = low.rlike("(?U)" + "|".join(RANKING))

    def met(edged: Column) -> Column:
        first = lambda items, test: F.get(F.filter(items, test), F.lit(0))["name"]
        tag = F.when(~ranking, first(tags, lambda t: F.exists(t["needles"], lambda n: F.contains(edged, n))))
        place = lambda items: first(items, lambda p: F.contains(edged, p["needle"]))
        return F.struct(tag.alias("tag"), place(cities).alias("city"), place(countries).alias("country"))

    def told(found: Column) -> Column:
        abroad, hidden, city = says(ABROAD), says(HIDDEN), found["city"]
        country = F.when(city.isNull(), found["country"])
        kind = F.when(abroad | city.isNotNull() | country.isNotNull(), "place").when(found["tag"].isNotNull(), "category").when(hidden, "hidden").when(says(MOMENTUM), "momentum").otherwise("overview")
        return F.struct(
            F.when(ranking, "momentum").otherwise(kind).alias("kind"), found["tag"].alias("tag"), city.alias("city"), F.when(~abroad, country).alias("country"),
            abroad.alias("non_us"), hidden.alias("hidden_only"), ranking.alias("ranking"),
        )

    # bound values, as each is named often
    bound = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    return bound(bound(_edged(low), met), told)
