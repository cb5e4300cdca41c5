"""URL filters: a table of host and path rules first, then a weighted URL vocabulary.

A rule names a host and the beginning of a path; it fits the host and all its subdomains, and the longest rule that fits (host
and path together) decides. URLs without a rule are judged by vocabulary: an Aho-Corasick automaton finds all terms of the
lower-cased URL (A-Z alone) in one scan, whatever the number of terms. A term counts where no letter (a-z or any character
beyond ASCII) stands right before or after it, so ``bet`` is not met in ``alphabet``. A strict term weighs as much as the limit
and rejects alone; soft terms weigh 1 and reject together once enough different ones are met; repeats of a term add nothing.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to ``?``, ``#`` or the end.
A null URL, or one without ``://``, has an empty host and path, meets no rule and is judged by its vocabulary like others (a null
one is allowed). Rows with equal ids or URLs are judged alike, each on its own; only the id and the URL are read; an empty
table gives an empty result. Rules and vocabulary are parameters and sent to every task: lists of some ten thousand
entries are fine there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ventura.llm.common import table
from ventura.session import ship


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Verdict, host and beginning of the path.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
#: Terms that reject alone, and terms of which SOFT_LIMIT different ones reject.
STRICT = ("adult", "bestiality", "blowjob", "casino", "camgirl", "camgirls", "cialis", "escorts", "hardcore", "hentai", "jackpot", "milf", "nudes", "phishing", "porn", "porno", "pornos", "sexcam", "sexcams", "slots", "viagra", "warez", "xxx", "xvideos")
SOFT = ("ads", "affiliate", "babes", "bet", "bets", "betting", "bonus", "buy", "cheap", "click", "clicks", "crack", "cracked", "credit", "dating", "deals", "discount", "download", "drugs", "escort", "farm", "free", "gambling", "girls", "hack", "hot", "keygen", "links", "loan", "loans", "lotto", "meds", "naked", "nude", "offer", "offers", "payday", "pharmacy", "pills", "poker", "promo", "replica", "seo", "serial", "sex", "sexy", "spam", "strip", "teen", "teens", "torrent", "torrents", "track", "tracker", "traffic", "win", "winner")
SOFT_LIMIT = 2
_END = re.compile(r"[/?#]")
_QUERY = re.compile(r"[?#]")


def lower_ascii(text: str) -> str:
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = _END.search(rest)
    host, tail = (rest[: end.start()], rest[end.start() :]) if end else (rest, "")
    return lower_ascii(host), _QUERY.split(tail, maxsplit=1)[0]


class Judge:
    """Rules by host, and the automaton."""

    def __init__(self, rules: Sequence[Rule] = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_limit: int = SOFT_LIMIT):
        self.by_host: dict[str, list[Rule]] = {}
        for r in sorted(rules, key=lambda r: (-len(r.path), r.path)):
            self.by_host.setdefault(r.host, []).append(r)
        self.soft_limit = soft_limit
        self.automaton = ahocorasick.Automaton()
        for weight, terms in ((1, soft), (soft_limit, strict)):
            for t in terms:
                self.automaton.add_word(t, (t, weight))
        if len(self.automaton):
            self.automaton.make_automaton()

    def rule(self, host: str, path: str) -> Rule | None:
        """The longest rule that fits."""
        best, at = None, 0
        while host:
            own = next((r for r in self.by_host.get(host[at:], ()) if path.startswith(r.path)), None)
            if own and (best is None or len(own.name) > len(best.name)):
                best = own
            at = host.find(".", at) + 1
            if not at:
                break
        return best

    def terms(self, url: str | None) -> dict[str, int]:
        """Distinct terms met, with their weights."""
        text = lower_ascii(url or "")
        letter = lambda c: "a" <= c <= "z" or c > "\x7f"
        found = {}
        for end, (term, weight) in self.automaton.iter(text) if len(self.automaton) else ():
            start = end - len(term)
            if not (start >= 0 and letter(text[start])) and not (end + 1 < len(text) and letter(text[end + 1])):
                found[term] = weight
        return found

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, int, int]:
        """host, path, rule, verdict, number of different strict and soft terms."""
        host, path = split_url(url)
        rule, found = self.rule(host, path), self.terms(url)
        strict = sum(w >= self.soft_limit for w in found.values())
        verdict = rule.verdict if rule else "block" if sum(found.values()) >= self.soft_limit else "allow"
        return host, path, rule.name if rule else None, verdict, strict, len(found) - strict


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[Rule] = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """Per row: id, host, path, rule, verdict, strict_hits, soft_hits. ``soft_limit`` is at least 2."""
    if soft_limit < 2:
        raise ValueError("with a limit below 2 soft terms were strict ones")
    ship(pages.sparkSession)

    names, kinds = ["host", "path", "rule", "verdict", "strict_hits", "soft_hits"], [pa.string()] * 4 + [pa.int64()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Judge(rules, strict, soft, soft_limit)
        for batch in batches:
            made = zip(*map(own.judge, batch.column(1).to_pylist())) if batch.num_rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(made, kinds))], ["id", *names])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    kind = rows.schema["id"].dataType.simpleString()
    made = rows.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string, strict_hits long, soft_hits long")
    return made.withColumnRenamed("id", id_col)


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages."""
    return filter_urls(table(spark, sf_dir, "pages"))


def _oracle() -> str:
    """The same by one regular expression per term."""
    listed = lambda terms: ", ".join(f"'{t}'" for t in terms)
    hits = lambda terms: f"len(list_filter([{listed(terms)}], lambda t: regexp_matches(u, '(^|[^a-z\\x{{80}}-\\x{{10FFFF}}])' || t || '($|[^a-z\\x{{80}}-\\x{{10FFFF}}])')))"
    rules = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
with a as (select row_number() over () rid, page_id, coalesce(url, '') url, case when contains(url, '://') then substr(url, position('://' in url) + 3) else '' end rest from pages),
b as (select *, {lower.format("regexp_extract(rest, '^[^/?#]*')")} host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') path, {lower.format("url")} u from a),
r(verdict, h, p) as (values {rules}),
m as (select rid, r.h || r.p rule, r.verdict from b join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) qualify row_number() over (partition by rid order by length(h || p) desc) = 1),
t as (select rid, {hits(STRICT)} strict_hits, {hits(SOFT)} soft_hits from b)
select page_id, host, path, m.rule, coalesce(m.verdict, case when strict_hits > 0 or soft_hits >= {SOFT_LIMIT} then 'block' else 'allow' end) verdict, strict_hits, soft_hits
from b join t using (rid) left join m using (rid)
"""


ORACLE = _oracle()
