"""Masking of answers in texts, and declined answers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ventura.functions.gazetteer import _tidy
from ventura.session import ship

YEAR_MASK, PLACE_MASK = "[YEAR]", "[PLACE]"
#: Years that are masked, words that tell a country, and words by which a model declines.
YEARS = r"(?U)\b(1[89]\d{2}|20[0-2]\d)\b"
DEMONYMS = (
    "american", "british", "chinese", "indian", "german", "french", "israeli", "japanese", "korean", "canadian", "australian", "dutch", "swedish", "spanish", "italian", "brazilian", "swiss", "singaporean",
    "u.s.", "us-based", "uk-based", "silicon valley", "bay area",
)
DECLINED = ("", "null", "none", "unknown", "n/a", "na", "not stated", "not specified", "not mentioned", "unspecified", "not provided", "nan", "unknown city", "unknown country", "-", "?")
ANSWERED_YEAR = r"^(1[89]\d{2}|20[0-3]\d)(\.0)?$"


def _literal(text: Column) -> Column:
    """A pattern of the text itself in any case; null for no text."""
    return F.when(text != "", F.concat(F.lit(r"(?iu)\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))


def scrub(text: Column, city: Column, country: Column) -> Column:
    """The text without what it should be asked for: years, then its own city and country anywhere, then whole words that tell a country."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), YEARS, YEAR_MASK)
    for place in (city, country):
        out = F.coalesce(F.regexp_replace(out, _literal(place), F.lit(PLACE_MASK)), out)
    words = "|".join(w.replace(".", r"\.") for w in DEMONYMS)
    return F.regexp_replace(out, rf"(?iuU)\b({words})\b", PLACE_MASK)


def answered(text: Column) -> Column:
    """An answer in lower case, a year without ``.0``; null where it declines."""
    value = F.lower(_tidy(text))
    year = F.regexp_extract(value, ANSWERED_YEAR, 1)
    return F.when(~value.isin(*DECLINED), F.when(year != "", year).otherwise(value))


_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mask_words(text: str, automaton) -> str:
    """The text with the automaton's phrases masked: of those that begin first the longest, with no letter, digit or ``_`` beside it.

    One scan finds all occurrences and one pass over them, by start and falling length, takes those that no taken one covers.
    """
    low = text.translate(_UPPER)
    word = lambda at: 0 <= at < len(low) and (low[at].isalnum() or low[at] == "_")
    found = sorted((end + 1 - n, -n) for end, n in automaton.iter(low) if not word(end + 1) and not word(end - n))
    out, done = [], 0
    for start, n in found:
        if start >= done:
            out += (text[done:start], PLACE_MASK)
            done = start - n
    return "".join((*out, text[done:]))


def automaton_of(phrases: tuple[str, ...]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for p in phrases:
        made.add_word(p.translate(_UPPER), len(p))
    made.make_automaton()
    return made


def mask_places(text: Column, phrases: tuple[str, ...]) -> Column:
    """``mask_words`` of any number of phrases in Arrow batches, in time linear in the texts but for sorting what is found; A-Z match
    a-z, null stays null, and without phrases texts stay as they are."""
    ship(SparkSession.active())
    phrases = tuple(p for p in phrases if p)
    if not phrases:
        return text

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        automaton = automaton_of(phrases)
        return texts.map(lambda t: None if t is None else mask_words(t, automaton))

    return masked(text)
