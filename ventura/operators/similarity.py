"""Similarity of names: bit-parallel longest common subsequences, and joins of all pairs of names above a threshold.

Similarity of x and y is 2 * LCS / (len x + len y) over their tokens in sorted order. Pairs of at least ``threshold`` are found
without meeting all others: a name is the set of its numbered bigrams (the second "an" of a name is another element than
the first), with a mark at both ends. With LCS L, names of n and m characters share at least 3 L + 1 - n - m of them: a deletion
spoils two bigrams and an insertion one. In one global order, the rarest first, two names that share T share k elements within
the first n + 1 - T + k, so every set of k elements of this prefix is a key, and only names with a common key meet. k is the
largest for which a name of that length has at most KEYS keys: up to five bigrams must coincide, where single ones would be shared
by a part of all names that does not shrink as the table grows. Lengths and 64-bit bitmaps of the bigrams rule out more
within the join; what is left is compared exactly.

Numbered names share nearly all their bigrams, and the pairs that share a key then grow with the square of the table. So where
the threshold leaves few characters to spare, names meet by what they have in common instead: names of n and m characters
with LCS of at least L share a subsequence of L characters, and each has C(n, L) and C(m, L) of these. Keys are the lengths with
such a subsequence; names that share one are similar, so the rows of the join follow those of the result. A pair of lengths goes
this way if neither name has more than SUBSEQUENCES, and only lengths that occur are taken; the others meet by bigrams.

The order comes from counts of hashed bigrams in a table of fixed size. Names are joined as distinct values: however many rows
have a name, it is one node; membership is for the caller to join back.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ventura.session import ship

#: Counters of the order, least threshold for which any two names share two bigrams, pairs compared at a time.
COUNTERS, LEAST, CHUNK = 1 << 16, 0.8, 2048
#: Most bigrams in a key, and most keys of a name for which more than two are taken.
WIDEST_KEY, KEYS = 5, 130
#: Most subsequences of a name that are keys for one length of the other.
SUBSEQUENCES = 300
_NO_X, _NO_Y = 0xFFFFFFFF, 0xFFFFFFFE  # no characters


def token_sorted(name: str) -> str:
    return " ".join(sorted(name.split()))


def _long_lcs(x: str, y: str) -> int:
    """The same recurrence over one integer of any length."""
    where: dict[str, int] = {}
    for i, c in enumerate(x):
        where[c] = where.get(c, 0) | 1 << i
    whole = (1 << len(x)) - 1
    s = whole
    for c in y:
        u = s & where.get(c, 0)
        s = (s + u | s - u) & whole
    return len(x) - s.bit_count()


def lcs_lengths(xs: list[str], ys: list[str]) -> np.ndarray:
    """LCS length of each pair. A pair's row of the table is one 64-bit word; a character of y updates the words of all pairs."""
    out = np.zeros(len(xs), np.int64)
    shorter, longer = zip(*((a, b) if len(a) <= len(b) else (b, a) for a, b in zip(xs, ys))) if len(xs) else ((), ())
    size = np.fromiter(map(len, shorter), np.int64, len(shorter))
    for k in np.flatnonzero(size > 64):
        out[k] = _long_lcs(shorter[k], longer[k])
    short = np.flatnonzero((size <= 64) & (size > 0))
    short = short[np.argsort([len(longer[k]) for k in short], kind="stable")]  # chunks of like lengths
    for rows in (short[k : k + CHUNK] for k in range(0, len(short), CHUNK)):
        code = lambda names, width, none: np.array([np.pad(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32), (0, width - len(t)), constant_values=none) for t in names])
        x = code([shorter[k] for k in rows], 64, _NO_X)
        y = code([longer[k] for k in rows], max(len(longer[k]) for k in rows), _NO_Y)
        s = np.full(len(rows), 2**64 - 1, np.uint64)
        for j in range(y.shape[1]):
            u = s & np.packbits(x == y[:, j : j + 1], axis=1, bitorder="little").view(np.uint64).ravel()
            s = (s + u) | (s - u)
        own = ~s & np.where(size[rows] == 64, np.uint64(2**64 - 1), (np.uint64(1) << (size[rows] % 64).astype(np.uint64)) - np.uint64(1))
        out[rows] = np.bitwise_count(own)
    return out


def ratios(xs: list[str], ys: list[str]) -> np.ndarray:
    """2 * LCS / total length; two empty texts are alike."""
    total = np.fromiter((len(a) + len(b) for a, b in zip(xs, ys)), np.int64, len(xs))
    return np.where(total == 0, 1.0, 2.0 * lcs_lengths(xs, ys) / np.maximum(total, 1))


def ratio(a: Column, b: Column) -> Column:
    """Similarity of two texts as they are; null with a null."""
    ship(SparkSession.active())

    @F.pandas_udf("double")
    def compared(x: pd.Series, y: pd.Series) -> pd.Series:
        there = (x.notna() & y.notna()).to_numpy()
        out = np.full(len(x), np.nan)
        out[there] = ratios(x[there].tolist(), y[there].tolist())
        return pd.Series(out).astype("Float64").where(there, pd.NA)

    return compared(a.cast("string"), b.cast("string"))


def tokens_sorted(name: Column) -> Column:
    """Tokens in code point order, single blanks between."""
    return F.array_join(F.array_sort(F.filter(F.split(name, r"(?U)\s+"), lambda t: t != "")), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    """Similarity of two names whatever the order of their tokens; case is not told apart."""
    return ratio(tokens_sorted(F.lower(a)), tokens_sorted(F.lower(b)))


def fuzzy_name_match(a: Column, b: Column) -> Column:
    """Similarity of two firms' names after normalisation; 0 if either has nothing left."""
    from ventura.functions.text import normalize_company_name

    x, y = normalize_company_name(a), normalize_company_name(b)
    return F.coalesce(token_sort_ratio(x, y), F.lit(0.0))


def least_lcs(n: int, m: int, threshold: float) -> int:
    return math.ceil(threshold * (n + m) / 2 - 1e-9)


@lru_cache(maxsize=None)
def least_shared(n: int, threshold: float) -> int:
    """Bigrams that a name of n characters shares with any other of at least ``threshold``."""
    widest = (2 - threshold) / threshold
    return min((3 * least_lcs(n, m, threshold) + 1 - n - m for m in range(math.ceil(n / widest - 1e-9), math.floor(n * widest + 1e-9) + 1) if least_lcs(n, m, threshold) <= min(n, m)), default=n + 1)


@lru_cache(maxsize=None)
def key_size(n: int, threshold: float) -> int:
    """Bigrams in a key of pairs whose shorter name has n characters."""
    spoilt = n + 1 - least_shared(n, threshold)
    return max((k for k in range(2, WIDEST_KEY + 1) if k <= least_shared(n, threshold) and math.comb(spoilt + k, k) <= KEYS), default=2)


@lru_cache(maxsize=None)
def key_sizes(n: int, threshold: float) -> tuple[tuple[int, int], ...]:
    """Key sizes of a name of n characters, as it may be the shorter or the longer of a pair, each with its prefix length."""
    shortest = math.ceil(n * threshold / (2 - threshold) - 1e-9)
    spoilt = n + 1 - least_shared(n, threshold)
    return tuple((k, spoilt + k) for k in sorted({key_size(m, threshold) for m in range(max(1, shortest), n + 1)}))


def by_subsequences(n: int, m: int, threshold: float) -> bool:
    """Whether names of n and m characters meet by common subsequences; else they meet by bigrams."""
    least = least_lcs(n, m, threshold)
    return least <= min(n, m) and max(math.comb(n, least), math.comb(m, least)) <= SUBSEQUENCES


@lru_cache(maxsize=None)
def _met_by(n: int, lengths: tuple[int, ...], threshold: float) -> tuple[tuple[int, ...], tuple[tuple[int, int], ...]]:
    """Of the ``lengths`` of other names, those that a name of n characters meets by subsequences, and its key sizes for the rest."""
    near = [m for m in lengths if least_lcs(n, m, threshold) <= min(n, m)]
    sizes = {key_size(min(n, m), threshold) for m in near if not by_subsequences(n, m, threshold)}
    return tuple(m for m in near if by_subsequences(n, m, threshold)), tuple(k for k in key_sizes(n, threshold) if k[0] in sizes)


def _lengths(names: DataFrame) -> tuple[int, ...]:
    """Lengths that occur: as many rows as there are different ones come to the driver."""
    return tuple(sorted(r["n"] for r in names.select(F.length("name").alias("n")).distinct().collect()))


def _bigrams(name: str) -> list[tuple[str, int]]:
    """Numbered bigrams, with marks at both ends."""
    seen: Counter[str] = Counter()
    whole, out = f"\x02{name}\x03", []
    for k in range(len(whole) - 1):
        g = whole[k : k + 2]
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def _hash(*parts: object) -> int:
    return zlib.crc32("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"))


def _order(names: DataFrame) -> np.ndarray:
    """How often hashed bigrams occur: at most COUNTERS rows come to the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for name in batch["name"]:
                for g in _bigrams(name):
                    n[_hash(*g) % COUNTERS] += 1
        there = np.flatnonzero(n)
        yield pd.DataFrame({"slot": there, "n": n[there]})

    out = np.zeros(COUNTERS, np.int64)
    for r in names.select("name").mapInPandas(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        out[r["slot"]] = r["n"]
    return out


def _keys(names: DataFrame, order: np.ndarray, threshold: float, lengths: tuple[int, ...] | None = None) -> DataFrame:
    """A row per name (block, name) and key: the sets of its prefix, as 64-bit numbers with the block in them.

    With the ``lengths`` of the names to meet, names that meet none of them by bigrams have no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for block, name in zip(batch["block"], batch["name"]):
                kinds = key_sizes(len(name), threshold) if lengths is None else _met_by(len(name), lengths, threshold)[1]
                if not kinds:
                    continue
                grams = _bigrams(name)
                bits = 0
                for g in grams:
                    bits |= 1 << (_hash(*g, "bit") & 63)
                grams.sort(key=lambda g: (order[_hash(*g) % COUNTERS], g))
                bits -= (bits >> 63) << 64
                for size, prefix in kinds:
                    for chosen in combinations(grams[:prefix], size):
                        made = "\x1f".join([block, *(f"{g}{k}" for g, k in chosen)]).encode("utf-8", "surrogatepass")
                        out.append((int.from_bytes(blake2b(made, digest_size=8).digest(), "big", signed=True), block, name, len(name), bits))
            yield pd.DataFrame(out, columns=["key", "block", "name", "n", "bits"])

    return names.select("block", "name").mapInPandas(run, "key long, block string, name string, n int, bits long")


def _subsequences(names: DataFrame, threshold: float, lengths: tuple[int, ...], first: bool, one_table: bool) -> DataFrame:
    """A row per name (block, name) and key: the lengths of both sides and a subsequence that a similar name has as well.

    In ``one_table`` the shorter name of a pair is of the ``first`` side and the longer one of the other.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for block, name in zip(batch["block"], batch["name"]):
                n, made = len(name), {}
                for m in _met_by(n, lengths, threshold)[0]:
                    if one_table and (n > m if first else n < m):
                        continue
                    least, both = least_lcs(n, m, threshold), (n, m) if first else (m, n)
                    if least not in made:
                        made[least] = set(combinations(name, least))
                    for chosen in made[least]:
                        key = f"{both}{block}\x1f{''.join(chosen)}".encode("utf-8", "surrogatepass")
                        out.append((int.from_bytes(blake2b(key, digest_size=8).digest(), "big", signed=True), block, name))
            yield pd.DataFrame(out, columns=["key", "block", "name"])

    return names.select("block", "name").mapInPandas(run, "key long, block string, name string")


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(similarity=ratios(batch["left"].tolist(), batch["right"].tolist()))


def similar_names(left: DataFrame, right: DataFrame | None = None, threshold: float = 0.92) -> DataFrame:
    """block, left, right, similarity of all pairs of names of one block with at least ``threshold``.

    ``left`` and ``right`` have columns ``block`` and ``name`` (token-sorted; null and empty ones match nothing, repeats count
    once). Without ``right``, each unordered pair of different names of ``left`` is given once, the smaller one left.
    """
    if not LEAST <= threshold <= 1:
        raise ValueError(f"a threshold from {LEAST} to 1 is needed, as shorter prefixes would miss pairs below")
    ship(left.sparkSession)
    named = lambda df: df.select(F.col("block").cast("string").alias("block"), F.col("name").cast("string").alias("name")).filter("block IS NOT NULL AND name <> ''").distinct()
    a, b = named(left), named(left if right is None else right)
    of_a = _lengths(a)
    of_b = of_a if right is None else _lengths(b)
    found = []
    if any(_met_by(n, of_b, threshold)[0] for n in of_a):
        x, y = _subsequences(a, threshold, of_b, True, right is None).alias("x"), _subsequences(b, threshold, of_a, False, right is None).alias("y")
        own = " AND (length(x.name) < length(y.name) OR x.name < y.name)" if right is None else ""
        met = x.join(y.hint("merge"), F.expr("x.key = y.key AND x.block = y.block" + own))
        sides = (F.col("x.name"), F.col("y.name")) if right is not None else (F.least("x.name", "y.name"), F.greatest("x.name", "y.name"))
        found.append(met.select("x.block", sides[0].alias("left"), sides[1].alias("right")))
    if any(_met_by(n, of_b, threshold)[1] for n in of_a):
        order = _order(a if right is None else a.unionByName(b))
        x = _keys(a, order, threshold, of_b)
        y = x if right is None else _keys(b, order, threshold, of_a)
        x, y = x.alias("x"), y.alias("y")
        lcs = f"ceil({threshold!r}D * (x.n + y.n) / 2 - 1e-9)"
        near = f"{lcs} <= least(x.n, y.n) AND bit_count(x.bits & ~y.bits) <= 2 * x.n + y.n - 3 * {lcs} AND bit_count(y.bits & ~x.bits) <= 2 * y.n + x.n - 3 * {lcs}"
        on = F.expr(f"x.key = y.key AND x.block = y.block AND {near}" + (" AND x.name < y.name" if right is None else ""))
        found.append(x.join(y.hint("merge"), on).select("x.block", F.col("x.name").alias("left"), F.col("y.name").alias("right")))
    if not found:
        return a.select("block", F.col("name").alias("left"), F.col("name").alias("right"), F.lit(None).cast("double").alias("similarity")).filter("false")
    pairs = (found[0] if len(found) == 1 else found[0].unionByName(found[1])).distinct()
    return pairs.mapInPandas(_compared, "block string, left string, right string, similarity double").filter(F.col("similarity") >= threshold)


def duplicate_report(df: DataFrame, id_col: str, name_col: str, threshold: float = 0.92) -> DataFrame:
    """Likely duplicates among firms: a, b, copies_a, copies_b, similarity.

    Firms of one normalised name (tokens in any order) are a class, named by its smallest id; a class of several firms is a row
    with b null and similarity 1, and two classes of at least ``threshold`` are a row with both ids, the smaller one first.
    """
    from ventura.functions.text import normalize_company_name

    named = df.select(F.col(id_col).alias("id"), tokens_sorted(normalize_company_name(F.col(name_col))).alias("name")).filter("name <> ''")
    classes = named.groupBy("name").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    pairs = similar_names(classes.withColumn("block", F.lit("")), threshold=threshold)
    a, b = (classes.select(F.col("name").alias(side), F.struct("id", "copies").alias(f"of_{side}")) for side in ("left", "right"))
    met = pairs.join(a, "left").join(b, "right").withColumn("both", F.array_sort(F.array("of_left", "of_right")))
    one, other = F.get("both", F.lit(0)), F.get("both", F.lit(1))
    across = met.select(one["id"].alias("a"), other["id"].alias("b"), one["copies"].alias("copies_a"), other["copies"].alias("copies_b"), "similarity")
    within = classes.filter("copies > 1").select(F.col("id").alias("a"), F.lit(None).cast(classes.schema["id"].dataType).alias("b"), F.col("copies").alias("copies_a"), F.lit(None).cast("long").alias("copies_b"), F.lit(1.0).alias("similarity"))
    return across.unionByName(within)


def best_matches(records: DataFrame, firms: DataFrame, threshold: float = 0.95) -> DataFrame:
    """For each record (id, name, country) its most similar firm (id, name, country): id, match_id, similarity.

    Only firms whose normalised name begins with the same character are compared; a firm of another country (in any case)
    never matches where both are known. Of equal similarities the smallest firm id wins. Records without a match have no row.
    """
    from ventura.functions.text import normalize_company_name

    def prepared(df: DataFrame) -> DataFrame:
        name = normalize_company_name(F.col("name"))
        return df.select("id", name.alias("norm"), F.nullif(F.lower(F.trim("country")), F.lit("")).alias("country")).filter("norm IS NOT NULL").select("id", F.left("norm", F.lit(1)).alias("block"), tokens_sorted(F.col("norm")).alias("name"), "country")

    asked = prepared(records)
    known = prepared(firms).groupBy("block", "name", "country").agg(F.min("id").alias("match_id"))
    pairs = similar_names(asked, known, threshold)
    met = asked.withColumnRenamed("name", "left").join(pairs, ["block", "left"])
    met = met.join(known.select("block", F.col("name").alias("right"), F.col("country").alias("theirs"), "match_id"), ["block", "right"])
    met = met.filter(F.col("country").isNull() | F.col("theirs").isNull() | (F.col("country") == F.col("theirs")))
    return met.groupBy("id").agg(F.max(F.struct("similarity", (-F.col("match_id")).alias("minus"))).alias("best")).select("id", (-F.col("best.minus")).alias("match_id"), F.col("best.similarity").alias("similarity"))


def domain_confidence(name: Column, domain: Column, rank: Column) -> Column:
    """How surely a search result's registrable domain is the firm's own, with .01 off per rank; null below any match.

    Name and domain label are compared as letters and digits alone, the name also without one of OPTIONAL at its end: .92 if
    equal, .78 if one begins the other and has at least .6 of its length, else .7 of a similarity of at least .88.
    """
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    norm, label = bare(name), bare(F.regexp_replace(domain, r"\.[^.]*$", ""))
    cuts = [F.when(norm.endswith(s) & (F.length(norm) > len(s) + 2), F.left(norm, F.length(norm) - len(s))) for s in OPTIONAL]

    def of(v: Column) -> Column:
        share = F.least(F.length(v), F.length(label)) / F.greatest(F.length(v), F.length(label))
        alike = ratio(v, label)
        return F.when((v == "") | (label == ""), None).when(v == label, 0.92).when(label.startswith(v) | v.startswith(label), F.when(share >= 0.6, 0.78)).when(alike >= 0.88, 0.7 * alike)

    return F.greatest(*(of(v) for v in (norm, *cuts))) - 0.01 * rank


#: Endings that firms often leave out of their domain.
OPTIONAL = ("ai", "hq", "app", "io", "labs", "inc")
