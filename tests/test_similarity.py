"""The similarity join against all pairs, and the rules of matching."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ventura.operators import similarity as S


def brute_lcs(x, y):
    row = [0] * (len(y) + 1)
    for c in x:
        before = row[:]
        for j, d in enumerate(y):
            row[j + 1] = before[j] + 1 if c == d else max(before[j + 1], row[j])
    return row[-1]


def test_lcs_equals_brute_force():
    rnd = random.Random(1)
    text = lambda: "".join(rnd.choice("abñ日🎉") for _ in range(rnd.choice([0, 1, 5, 20, 63, 64, 65, 130])))
    xs, ys = zip(*((text(), text()) for _ in range(300)))
    assert S.lcs_lengths(list(xs), list(ys)).tolist() == [brute_lcs(a, b) for a, b in zip(xs, ys)]
    assert S.ratios([], []).tolist() == [] and S.ratios([""], [""]).tolist() == [1.0] and S.ratios(["a"], [""]).tolist() == [0.0]


@pytest.mark.parametrize("threshold", [0.8, 0.85, 0.92, 0.95, 1.0])
def test_prefixes_exist_for_every_length(threshold):
    assert all(p <= n + 1 for n in range(1, 400) for _, p in S.key_sizes(n, threshold))


def names(seed, count):
    """Names in families that differ by some letters, numbers that share nearly all bigrams, and copies."""
    rnd = random.Random(seed)
    parts = ["nova", "data", "quantum", "health", "bright", "green", "mind", "ñandú", "größe", "robotics", "analytics", "cloud", "bio", "xy"]
    out = []
    while len(out) < count:
        kind = rnd.random()
        base = " ".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4))) if kind < 0.6 else f"customer {rnd.randint(1, 4000):09d}" if kind < 0.9 else rnd.choice("abc") * rnd.randint(1, 5)
        for _ in range(rnd.randint(1, 4)):
            s = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
                k = rnd.randrange(len(s) + 1)
                s[k : k + rnd.randint(0, 1)] = rnd.choice(["", rnd.choice("abcdeñ0123")])
            out.append(S.token_sorted("".join(s)))
    return out[:count]


@pytest.mark.parametrize(("threshold", "count"), [(0.92, 2000), (0.8, 500)])
def test_all_pairs_equal_brute_force(spark, threshold, count):
    given = names(7, count)
    distinct = sorted({n for n in given if n})
    i, j = np.triu_indices(len(distinct), 1)
    left, right = [distinct[k] for k in i], [distinct[k] for k in j]
    near = S.ratios(left, right) >= threshold  # lcs_lengths itself is held against brute force above
    want = sorted((left[k], right[k]) for k in np.flatnonzero(near))
    df = spark.createDataFrame([("", n) for n in given] + [("", None), ("", "")], "block string, name string")
    got = S.similar_names(df, threshold=threshold).collect()
    assert sorted((r["left"], r["right"]) for r in got) == want and len(want) > 100


def test_best_matches_equal_brute_force(spark):
    rnd = random.Random(3)
    land = lambda: rnd.choice(["US", "us", "France", None, ""])
    firms = [(k, n.title(), land()) for k, n in enumerate(names(8, 2000))]
    records = [(k, n.upper() + rnd.choice([" Inc.", "", " Labs"]), land()) for k, n in enumerate(names(9, 250) + [f[1] for f in firms[::20]])]
    schema = "id long, name string, country string"
    frames = [spark.createDataFrame(rows, schema) for rows in (records, firms)]
    got = {r["id"]: (r["match_id"], round(r["similarity"], 9)) for r in S.best_matches(*frames).collect()}

    from ventura.functions.text import normalize_company_name

    norm = [{r["id"]: r["n"] for r in f.select("id", normalize_company_name(F.col("name")).alias("n")).collect()} for f in frames]
    want = {}
    for i, _, country in records:
        if (x := norm[0][i]) is None:
            continue
        near = [(k, c) for k, _, c in firms if norm[1][k] and norm[1][k][0] == x[0] and not (country and c and country.lower() != c.lower())]
        score = S.ratios([S.token_sorted(x)] * len(near), [S.token_sorted(norm[1][k]) for k, _ in near])
        best = max(((s, -k) for s, (k, _) in zip(score, near) if s >= 0.95), default=None)
        if best:
            want[i] = (-best[1], round(best[0], 9))
    assert got == want and len(want) > 100


def test_country_veto_takes_the_next_best(spark):
    schema = "id long, name string, country string"
    firms = spark.createDataFrame([(1, "Brightwater Robotics", "France"), (2, "Brightwatre Robotics", "US"), (3, "Zrightwater Robotics", "US")], schema)
    asked = spark.createDataFrame([(1, "Brightwater Robotics Inc.", "us"), (2, "Brightwater Robotics", None), (3, "Brightwater Robotics", "Peru"), (4, None, "US"), (5, "Inc.", "US")], schema)
    assert {r["id"]: r["match_id"] for r in S.best_matches(asked, firms).collect()} == {1: 2, 2: 1}


def test_duplicate_report_of_copies(spark):
    rows = [(k, "Nova Health Robotics Inc.") for k in range(10, 500)] + [(5, "Robotics Health Nova"), (7, "Nova Healthh Robotics"), (8, "Other Thing"), (9, None)]
    got = sorted((tuple(r) for r in S.duplicate_report(spark.createDataFrame(rows, "id long, name string"), "id", "name").collect()), key=str)
    assert [(a, b, m, n) for a, b, m, n, _ in got] == [(5, 7, 491, 1), (5, None, 491, None)]


def candidates(spark, given):
    """Rows of the join before the exact comparison."""
    df = spark.createDataFrame([("c", n) for n in given], "block string, name string").distinct()
    keys = S._keys(df, S._order(df), 0.95)
    x, y = keys.alias("x"), keys.alias("y")
    return x.join(y, F.expr("x.key = y.key AND x.name < y.name")).count()


def test_candidates_do_not_grow_with_the_square_of_a_block(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("bcdfghklmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(2, 4)))
    given = [f"c{word()} {word()} {word()}" for _ in range(6000)]
    few, many = candidates(spark, given[:1500]), candidates(spark, given)
    assert many < 8 * max(few, 1500), (few, many)
    numbered = candidates(spark, [f"customer {k:09d}" for k in range(4000)])  # the hard case: one block, nearly all bigrams shared
    assert numbered < 4000 * 3999 / 2 / 10, numbered


@pytest.mark.parametrize("one_table", [True, False])
def test_numbered_names_meet_by_common_subsequences_alone(spark, one_table):
    """Keys of numbered names grow with the table, and rows of their join with the result: both were quadratic by bigrams."""
    for count in (1000, 4000):
        df = spark.createDataFrame([("c", f"{k * 37 + 5:09d} customer") for k in range(count)], "block string, name string")
        other = df if one_table else df.select("block", F.replace("name", F.lit("customer"), F.lit("custommer")).alias("name"))
        given, asked = S._lengths(df), S._lengths(other)
        assert S._met_by(18, asked, 0.95)[1] == ()  # none by bigrams
        keys = S._subsequences(df, 0.95, asked, True, one_table), S._subsequences(other, 0.95, given, False, one_table)
        met = keys[0].alias("x").join(keys[1].alias("y"), "key")
        assert met.count() <= 2 * count and keys[0].count() <= 20 * count and keys[1].count() <= 20 * count
        assert S.similar_names(df, None if one_table else other, 0.95).count() == (0 if one_table else count)


def test_names_that_meet_either_way_equal_brute_force(spark):
    """Lengths on either side of the limit of subsequences, two tables of different lengths, characters repeated."""
    rnd = random.Random(11)
    left = [f"{rnd.randrange(10**k):0{k}d} {'aab' * j}" for k in (3, 9, 12) for j in range(1, 14) for _ in range(8)]
    right = [S.token_sorted("".join(c for c in n if rnd.random() > 0.03) + rnd.choice(["", "b", "aa"])) for n in left]
    frames = [spark.createDataFrame([("c", n) for n in side], "block string, name string") for side in (left, right)]
    for threshold in (0.9, 0.95, 1.0):
        pairs = [(x, y) for x in sorted({*left}) for y in sorted({*right})]
        near = S.ratios(*map(list, zip(*pairs))) >= threshold
        got = sorted((r["left"], r["right"]) for r in S.similar_names(*frames, threshold).collect())
        assert got == [p for p, n in zip(pairs, near) if n] and len(got) > 5
        ways = {S.by_subsequences(len(x), len(y), threshold) for x, y in got}
        assert ways == ({True} if threshold == 1 else {True, False})


def test_domain_confidence(spark):
    rows = [("Scale AI", "scale.com", 0, 0.92), ("Scale", "scaleai.com", 1, 0.77), ("Acme", "zzz.com", 0, None), ("Anthropicc", "anthropick.com", 0, 0.63), ("A", "abcdefgh.com", 0, None), ("!!", "x.com", 0, None)]
    df = spark.createDataFrame(rows, "name string, domain string, rank int, want double")
    for r in df.withColumn("got", S.domain_confidence(F.col("name"), F.col("domain"), F.col("rank"))).collect():
        assert r["got"] == pytest.approx(r["want"]) if r["want"] is not None else r["got"] is None, r


def test_fuzzy_name_match_expectations(spark):
    rows = [("OpenAI", "openai", 1.0, 1.0), ("Anthropic", "Anthropic Inc.", 0.9, 1.0), ("Google", "Microsoft", 0.0, 0.5), ("DeepMind", "Deep Mind Labs", 0.8, 1.0), ("", "x y", 0.0, 0.0), (None, "xx", 0.0, 0.0), ("Inc.", "xx", 0.0, 0.0)]
    df = spark.createDataFrame(rows, "a string, b string, low double, high double")
    for r in df.withColumn("s", S.fuzzy_name_match(F.col("a"), F.col("b"))).collect():
        assert r["low"] <= r["s"] <= r["high"], r
