"""Fields of imported firms: years, sizes, amounts, categories and tags."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ventura.functions.gazetteer import _tidy
from ventura.functions.places import _lookup

#: Words of a dump that stand for nothing.
NOTHING = ("nan", "none", "null", "")
#: Verticals, with the category groups of the one dump and the industry groups of the other.
GROUPS = {
    "Software & IT": ("Software", "Information Technology", "Apps", "Mobile", "Internet Services"),
    "Healthcare": ("Health Care",),
    "Biotech & Pharma": ("Biotechnology", "Science and Engineering"),
    "Financial Services": ("Financial Services", "Lending and Investments", "Blockchain and Cryptocurrency"),
    "E-commerce & Retail": ("Commerce and Shopping", "Consumer Goods", "Clothing and Apparel"),
    "Media & Marketing": ("Media and Entertainment", "Advertising", "Content and Publishing", "Video", "Music and Audio", "Sports"),
    "Education": ("Education",),
    "Energy & CleanTech": ("Energy", "Sustainability", "Natural Resources"),
    "Hardware & Manufacturing": ("Hardware", "Manufacturing", "Consumer Electronics"),
    "Transportation": ("Transportation",),
    "Real Estate": ("Real Estate",),
    "Food & AgTech": ("Food and Beverage",),
    "Security & Privacy": ("Privacy and Security",),
    "Data & Analytics": ("Data and Analytics",),
    "Professional Services": ("Professional Services", "Administrative Services", "Design", "Government and Military"),
    "Consumer & Lifestyle": ("Community and Lifestyle", "Travel and Tourism", "Events"),
    "Social Impact": ("Social Impact",),
}
INDUSTRIES = {
    "Software & IT": ("Software", "IT Services", "Communications and Networking"),
    "Healthcare": ("Healthcare Services", "Healthcare Devices and Supplies", "Healthcare Technology Systems"),
    "Biotech & Pharma": ("Pharmaceuticals and Biotechnology",),
    "Financial Services": ("Other Financial Services", "Capital Markets/Institutions", "Insurance"),
    "E-commerce & Retail": ("Retail", "Consumer Non-Durables", "Consumer Durables", "Apparel and Accessories"),
    "Media & Marketing": ("Media",),
    "Education": ("Education",),
    "Energy & CleanTech": ("Other Energy", "Exploration, Production and Refining", "Environmental Services"),
    "Hardware & Manufacturing": ("Computer Hardware", "Commercial Products", "Metals, Minerals and Mining", "Chemicals and Gases"),
    "Transportation": ("Transportation", "Commercial Transportation"),
    "Real Estate": ("Real Estate",),
    "Food & AgTech": ("Food and Beverage", "Agriculture"),
    "Professional Services": ("Commercial Services", "Services (Non-Financial)", "Government"),
    "Consumer & Lifestyle": ("Restaurants, Hotels and Leisure",),
}
VERTICAL_OF_GROUP = {group: vertical for vertical, listed in GROUPS.items() for group in listed}
VERTICAL_OF_INDUSTRY = {group: vertical for vertical, listed in INDUSTRIES.items() for group in listed}
#: The group of AI firms, words of AI categories, and tags of well-known ones.
AI_GROUP = "artificial intelligence"
AI_CATEGORIES = (
    "artificial intelligence", "machine learning", "computer vision", "natural language", "deep learning", "neural network", "generative ai", "robotic", "autonomous vehicle",
    "speech recognition", "predictive analytic", "intelligent system", "image recognition", "data science", "ml ops", "mlops", "voice recognition",
)
AI_TAGS = {
    "artificial intelligence (ai)": "artificial-intelligence", "artificial intelligence": "artificial-intelligence", "machine learning": "machine-learning", "deep learning": "deep-learning",
    "computer vision": "computer-vision", "natural language processing": "nlp", "generative ai": "generative-ai", "neural networks": "neural-networks", "robotics": "robotics",
    "robotic process automation (rpa)": "rpa", "predictive analytics": "predictive-analytics", "intelligent systems": "intelligent-systems", "speech recognition": "speech-recognition",
    "autonomous vehicles": "autonomous-vehicles", "image recognition": "image-recognition", "data science": "data-science", "big data": "big-data",
}
#: Scores of a firm in the AI group, with an AI category, and of any other.
GROUP_SCORE, CATEGORY_SCORE, OTHER_SCORE = 0.9, 0.75, 0.6
#: A number as it is written in a dump, and the size of a unit of deals.
NUMERAL, MILLION = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$", 1_000_000


def cleaned(text: Column) -> Column:
    """Trimmed, null where a word for nothing stands."""
    value = _tidy(text)
    return F.when(~F.lower(value).isin(*NOTHING), value)


def leading_year(text: Column) -> Column:
    """The four digits that a date begins with, from 1900 to 2100, else null."""
    year = F.regexp_extract(cleaned(text), r"^(\d{4})", 1).try_cast("int")
    return F.when(year.between(1900, 2100), year)


def least_employees(text: Column) -> Column:
    """The first number of ``51-100`` or ``10000+``, else null; a comma ends a number."""
    return F.regexp_extract(cleaned(text), r"(\d+)", 1).try_cast("bigint")


def amount(text: Column) -> Column:
    """A written number as double; zero, like anything that is no number, is null."""
    return F.nullif(F.when(text.rlike(NUMERAL), F.trim(text).try_cast("double")), F.lit(0.0))


def deal_size(text: Column) -> Column:
    """A number of millions as double; zero stays, what is no number is null."""
    return F.when(text.rlike(NUMERAL), F.trim(text).try_cast("double")) * MILLION


def verticals_of_groups(listed: Column) -> Column:
    """Verticals of comma-joined category groups, each once in order of its first group; none for null, empty and unknown groups."""
    names = F.transform(F.split(F.coalesce(listed, F.lit("")), ","), lambda g: _lookup(VERTICAL_OF_GROUP, _tidy(g)))
    return F.array_distinct(F.filter(names, lambda v: v.isNotNull()))


def vertical_of_industry(group: Column) -> Column:
    """The vertical of an industry group as array of one, else none."""
    return F.array_compact(F.array(_lookup(VERTICAL_OF_INDUSTRY, _tidy(group))))


def _tells_ai(low: Column) -> Column:
    return low.rlike("|".join(map(re.escape, AI_CATEGORIES)))


def ai_score(categories: Column, groups: Column) -> Column:
    """Score of a new firm by its groups, then its categories."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return F.when(F.contains(low(groups), F.lit(AI_GROUP)), GROUP_SCORE).when(_tells_ai(low(categories)), CATEGORY_SCORE).otherwise(OTHER_SCORE)


def ai_tags(categories: Column) -> Column:
    """Tags of the comma-joined categories that tell AI, each once in order: the well-known tag, else the words with hyphens."""
    made = F.transform(
        F.split(F.lower(F.coalesce(categories, F.lit(""))), ","),
        lambda c: F.coalesce(_lookup(AI_TAGS, _tidy(c)), F.when(_tells_ai(c), F.translate(_tidy(c), " ()", "-"))),
    )
    return F.array_distinct(F.array_compact(made))
