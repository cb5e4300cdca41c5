"""Operators 11 to 13 against brute force and their oracles."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from tests.compare import connect, same
from tests.llm.helpers import AWKWARD, DIR, frame, input_dir
from ventura.llm import period_runs as P
from ventura.llm import source_divergence as S
from ventura.llm import url_filters as U


def brute_runs(x):
    """Every period is tried at every place."""
    n, out = len(x), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and x[j] == x[j + q]:
                j += 1
            length = j + q - i
            if length >= max(24, 3 * q) and not any(q % k == 0 and all(x[t] == x[t + k] for t in range(i, i + length - k)) for k in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences(seed, count, longest):
    rnd = random.Random(seed)
    for _ in range(count):
        x = []
        while len(x) < longest and (not x or rnd.random() < 0.8):
            unit = [rnd.randint(0, rnd.choice([1, 2, 40])) for _ in range(rnd.randint(1, rnd.choice([3, 10, 30, 70])))]
            if rnd.random() < 0.4:
                unit = unit * rnd.randint(2, 6) + [rnd.randint(0, 2)]
            x += (unit * rnd.randint(1, 9))[: rnd.randint(1, 250)]
        yield x[:longest]


def test_runs_equal_brute_force():
    found = 0
    for x in sequences(3, 250, 500):
        want = brute_runs(x)
        assert P.find_runs(np.array(x, np.int64)) == want, x
        found += len(want)
    assert found > 500


def test_runs_at_the_limits():
    unit = list(range(8))
    assert P.find_runs(np.array(unit * 3)) == [(0, 24, 8)]
    assert P.find_runs(np.array(unit * 3 + [0])) == [(0, 25, 8)]
    assert P.find_runs(np.array((unit * 3)[:-1])) == []
    assert P.find_runs(np.array([0] * 23)) == [] and P.find_runs(np.array([0] * 24)) == [(0, 24, 1)]
    for q in (15, 16, 17, 31, 32, 33, 63, 64, 65):  # around the scales
        for before in (0, 1, 7):
            x = np.array([900 + k for k in range(before)] + list(range(q)) * 3 + [800])
            assert P.find_runs(x) == [(before, 3 * q, q)]
            assert P.find_runs(np.delete(x, before)) == []


@pytest.mark.parametrize("make", [lambda n: [0] * n, lambda n: ([0] * (n // 3 - 1) + [1]) * 3, lambda n: [k % 1000 for k in range(n)]])
def test_runs_of_long_periodic_texts_take_linear_time(make):
    import time

    took = []
    for n in (40_000, 160_000):
        began = time.process_time()
        assert P.find_runs(np.array(make(n)))
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.5


def expected_runs(doc_id, text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    ids = {w: k for k, w in enumerate(dict.fromkeys(words))}
    runs = brute_runs([ids[w] for w in words])
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


OUT = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_op11_awkward(spark, tmp_path):
    hot = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 10 == 0)
    big = next(i for i in range(2**60, 2**60 + 100) if zlib.crc32(str(i).encode()) % 10 == 0)
    texts = [(i, t if t is None or len(t) < 50_000 else " ".join(t.split(" ")[:700])) for i, t in AWKWARD]
    texts += [(hot, " ".join(f"w{k}" for k in range(90))), (big, " ".join(f"v{k}" for k in range(90))), (21, "a b c " * 9 + "x " + "a b c " * 12), (22, "same " * 60 + "a b " * 20)]
    got = P.op11_period_runs(spark, input_dir(spark, tmp_path, frame(spark, texts)))
    assert sorted((tuple(r[c] for c in OUT) for r in got.collect()), key=str) == sorted((expected_runs(i, t) for i, t in texts), key=str)


def test_op11_table(spark):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect() if len(r["text"] or "") < 4000}
    got = [tuple(r[c] for c in OUT) for r in P.op11_period_runs(spark, DIR).collect() if r["doc_id"] in rows]
    assert sorted(got) == sorted(expected_runs(i, t) for i, t in rows.items()) and sum(g[1] for g in got) > 3


def test_op11_empty(spark, tmp_path):
    assert P.op11_period_runs(spark, input_dir(spark, tmp_path, frame(spark, []))).count() == 0


def test_op12_oracle(spark):
    same(S.op12_source_divergence(spark, DIR), connect(DIR), S.ORACLE)


def brute_audit(rows, least, top=10):
    import re

    n, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        n[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {k[0] for k in n}:
        kept = sorted(t for t, d in docs[lang].items() if d >= least)
        share = lambda c, k: 1 + 10**9 * (c + 2) // (sum(k[t] for t in kept) + 2 * len(kept))
        whole = sum((n[k] for k in n if k[0] == lang), Counter())
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for source in {k[1] for k in n if k[0] == lang}:
            own = n[lang, source]
            pairs = [(sum(f(share(own[t], own), share(n[lang, o][t], n[lang, o])) for t in kept), o) for _, o in [k for k in n if k[0] == lang and k[1] != source]]
            terms = [(f(share(own[t], own), share(whole[t], whole)), t) for t in kept if own[t] and share(own[t], own) > share(whole[t], whole)]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                out += [(lang, source, part, item, v, k + 1) for k, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most])]
    return sorted(out)


def texts_of(seed, count, sources):
    rnd = random.Random(seed)
    words = [f"w{chr(97 + k % 26)}{'abc'[k % 3] * (k // 26)}" for k in range(90)] + ["Größe", "ÄTNA", "日本", "Straße"]
    return [(rnd.choice(["en", "de", None]), rnd.choice([*(f"s{k}" for k in range(sources)), None]), " ".join(rnd.choice(words[: rnd.randint(1, len(words))]) for _ in range(rnd.randint(0, 30)))) for _ in range(count)] + [("xx", "lone", None), ("xx", "other", "rare"), ("yy", "s", ""), (None, None, None)]


def audit_of(spark, rows, **more):
    made = spark.createDataFrame([(k, t, a, b, 1, "x", 2) for k, (a, b, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n long, term string, g int")
    return sorted(tuple(r) for r in S.audit(made, **more).collect())


def test_op12_equals_brute_force(spark, monkeypatch):
    rows = texts_of(1, 160, 5)
    assert audit_of(spark, rows) == brute_audit(rows, 10)
    monkeypatch.setattr(S, "TABLE_ROWS", 20)  # tables and tallies that overflow
    monkeypatch.setattr(S, "TALLY_ROWS", 30)
    assert audit_of(spark, rows, least_docs=3, top=4) == brute_audit(rows, 3, 4)


def test_op12_many_sources_meet_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 3)
    rows = texts_of(2, 200, 11)
    assert audit_of(spark, rows, least_docs=4) == brute_audit(rows, 4)


def test_op12_counts_beyond_64_bit_products(spark):
    (row,) = spark.range(1).selectExpr("10000000000L n", "40000000000L total", "3L v").select(S._share("n", "total", "v").alias("p")).collect()
    assert row["p"] == 1 + 10**9 * (10**10 + 2) // (4 * 10**10 + 6)


def test_op12_empty(spark, tmp_path):
    assert S.op12_source_divergence(spark, input_dir(spark, tmp_path, frame(spark, []))).count() == 0


URLS = [
    "http://a.net/x", "http://a.net", "http://net/", "http://xnet/", "HTTP://A.Example.NET/en/1?q=/en/", "http://example.net/de/", "https://b.example.com/de/1", "https://b.example.com/DE/1", "https://org/fr/", "https://x.org/fr", "https://x.org/fr/#a/b",
    "https://x.org/?u=http://a.net/", "no scheme casino", "casino://x.org/", None, "", "://", "https://", "http://user@a.net:80/x", "http://a.net:80/", "https://casino-win.org/", "https://alphabet.org/free/", "https://freebet.org/free-bet", "https://bet.org/bet/bet", "https://x.org/bet/free?bet",
    "https://ünïcasino.org/", "https://casinoé.org/", "https://CASINO.org/", "https://İ.ORG/Casino", "https://xxx.org#top", "https://x.org/cheap%20pills", "https://adult-x.example.com/en/1", "https://x.org/" + "free" * 20_000, "https://x.org/" + "a/" * 20_000 + "slots", "https://net./", "a?b://c/d",
]


def test_op13_oracle(spark):
    same(U.op13_url_filters(spark, DIR), connect(DIR), U.ORACLE)


def test_op13_awkward(spark, tmp_path):
    made = spark.createDataFrame([(k, u, "<p>", "clash", 7) for k, u in enumerate(URLS)] + [(None, URLS[0], None, None, None), (1, URLS[20], "", "", 1), (2**62 + 1, "http://a.net/x", "", "", 1)], "page_id long, url string, html string, rule string, id int")
    made.write.parquet(f"{tmp_path}/pages.parquet")
    for name in ("documents", "region"):
        spark.range(1).write.parquet(f"{tmp_path}/{name}.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = U.op13_url_filters(spark, str(tmp_path))
    same(got, con, U.ORACLE)
    by = {URLS[r["page_id"]]: r for r in got.collect() if r["page_id"] is not None and r["page_id"] < len(URLS)}
    assert [by[u]["rule"] for u in URLS[:7]] == ["net/", None, "net/", None, "example.net/en/", "net/", "example.com/de/"]
    assert (by["https://x.org/?u=http://a.net/"]["host"], by["https://x.org/?u=http://a.net/"]["path"]) == ("x.org", "/")
    assert by["https://x.org/bet/free?bet"]["verdict"] == "block" and by["https://bet.org/bet/bet"]["verdict"] == "allow"
    assert by["https://alphabet.org/free/"]["soft_hits"] == 1 and by["https://casinoé.org/"]["verdict"] == "allow" and by["https://CASINO.org/"]["verdict"] == "block"
    assert by[None]["host"] == "" and by[None]["verdict"] == "allow"


def test_op13_longest_rule_and_vocabulary_of_the_caller(spark):
    rules = [U.Rule("block", "b.c", "/"), U.Rule("allow", "c", "/long/path/"), U.Rule("block", "a.b.c", "/x")]
    made = spark.createDataFrame([(1, "http://a.b.c/long/path/1"), (2, "http://a.b.c/x/1"), (3, "http://q.b.c/long"), (4, "http://c/"), (5, "http://d/bad")], "n int, u string")
    got = {r["n"]: (r["rule"], r["verdict"]) for r in U.filter_urls(made, "n", "u", rules, ["bad"], []).collect()}
    assert got == {1: ("c/long/path/", "allow"), 2: ("a.b.c/x", "block"), 3: ("b.c/", "block"), 4: (None, "allow"), 5: (None, "block")}


def test_op13_empty(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    assert U.op13_url_filters(spark, str(tmp_path)).count() == 0
