"""Periodic run detection: every maximal stretch of words that repeats with a period, found by matching blocks.

Words become integers by first appearance. At each scale L = 8, 16, 32, ... the document is cut into aligned blocks of L
words; an Aho-Corasick automaton over these integer sequences finds all places of every block in the document. A run of
smallest period q and at least max(24, 3q) words holds, at the scale L with L <= q < 2L (L = 8 for all q < 16), an aligned
block together with its copy q words later: the first len - q >= 2L - 1 words hold one. So each pair of a block and an
occurrence of it at a distance of [L, 2L) (1 to 15 at the first scale) seeds a stretch, which is grown word by word in
both directions; stretches that are long enough and have no smaller period are the runs. Nothing is hashed or sampled.

A block that itself is periodic occurs in chains, one step of its own period apart. Within a chain only two distances can
belong to a run: the ones that bring the ends of the two periodic surroundings of block and chain together (any other
distance breaks at such an end, before three periods); both are tried, so a block has a bounded number of seeds. A block
of the next scale can recur only if both its halves do, so text without repeats ends after the first scale, and its key is
the pair of its halves' numbers, so that the automaton stays shallow on periodic text. Time is about n log n for n words.

Each row is worked on by itself, without a shuffle. Null text counts as empty (no words, no runs). Rows with equal ids are
separate; a null id stays null (the query's planted repeats need an id, so such a row is taken as it is); an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ventura.llm.common import table
from ventura.session import ship

#: Shortest run in words and in periods. FIRST_BLOCK must be at most (LEAST_WORDS + 1 - FIRST_BLOCK) / 2.
LEAST_WORDS, LEAST_PERIODS, FIRST_BLOCK = 24, 3, 8
WORD = re.compile(r"[^\x20\x09-\x0D]+")

Run = tuple[int, int, int]  # start, length, period
_RUNS = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))


def _agree(u: np.ndarray, v: np.ndarray) -> int:
    """Number of equal elements before the first difference of two arrays of one length."""
    k, step = 0, 32
    while k < len(u):
        differ = u[k : k + step] != v[k : k + step]
        if differ.any():
            return k + int(differ.argmax())
        k, step = k + step, step * 2
    return len(u)


class Stretches:
    """Maximal stretches of a given period; each is grown once."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.known: dict[int, list[tuple[int, int]]] = {}

    def around(self, start: int, end: int, period: int) -> tuple[int, int]:
        """The stretch of ``period`` around [start, end), which has that period."""
        own = self.known.setdefault(period, [])
        k = bisect_right(own, (start, len(self.x))) - 1
        if k >= 0 and own[k][1] >= end:
            return own[k]
        left = _agree(self.x[:start][::-1], self.x[period : start + period][::-1])
        right = _agree(self.x[end - period : len(self.x) - period], self.x[end:])
        insort(own, found := (start - left, end + right))
        return found


def _divisors(period: int) -> Iterator[int]:
    """``period`` over each of its prime factors."""
    rest, p = period, 2
    while p * p <= rest:
        if rest % p == 0:
            yield period // p
            while rest % p == 0:
                rest //= p
        p += 1
    if rest > 1:
        yield period // rest


def _distances(block: int, size: int, later: np.ndarray, stretches: Stretches) -> Iterator[int]:
    """Distances from a block to later occurrences that may be the period of a run."""
    if len(later) < 3:
        yield from (later - block).tolist()
        return
    for chain in np.split(later, np.flatnonzero(np.diff(later) > size // 2) + 1):
        if len(chain) < 3:
            yield from (chain - block).tolist()
            continue
        own = int(chain[1] - chain[0])
        here, there = (stretches.around(at, at + size, own) for at in (block, int(chain[0])))
        for d in {there[0] - here[0], there[1] - here[1]}:
            k = int(np.searchsorted(chain, block + d))
            if k < len(chain) and chain[k] == block + d:
                yield d


def _search(sequence: list[int], keys: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Where each key ends in the sequence, and the key's number from 1 (all keys have one length, so an end has one at most)."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for k, key in enumerate(keys):
        automaton.add_word(key, k + 1)
    automaton.make_automaton()
    hits = np.fromiter((v for hit in automaton.iter(tuple(sequence)) for v in hit), np.int64)
    return hits[::2], hits[1::2]


def _names(x: np.ndarray, live: list[int], size: int, halves: np.ndarray) -> np.ndarray:
    """For each place of the document the number of the live block that stands there too, or 0.

    A block of the first scale is a key of its words. Later ones are keys of two integers, the ``halves`` numbers of their halves: the
    numbers are read a half apart, one remainder after the other, so that the automaton stays two levels deep.
    """
    n = len(x)
    if size == FIRST_BLOCK:
        words = x.tolist()
        ends, number = _search(words, list(dict.fromkeys(tuple(words[b : b + size]) for b in live)))
        at = ends - size + 1
    else:
        half = size // 2
        rows = -(-n // half)
        by_remainder = np.zeros((half, rows + 1), np.int64)  # a column of zeros parts the remainders; no key holds a zero
        padded = np.zeros(rows * half, np.int64)
        padded[: len(halves)] = halves
        by_remainder[:, :rows] = padded.reshape(rows, half).T
        ends, number = _search(by_remainder.ravel().tolist(), list(dict.fromkeys((int(halves[b]), int(halves[b + half])) for b in live)))
        at = (ends % (rows + 1) - 1) * half + ends // (rows + 1)
    out = np.zeros(n, np.int64)
    out[at] = number
    return out


def find_runs(x: np.ndarray) -> list[Run]:
    """All runs of a sequence of integers from 0 to 2^32 - 1, by start, then period."""
    n, found, stretches, size = len(x), set(), Stretches(x), FIRST_BLOCK
    live, names = list(range(0, n - size + 1, size)), x
    while live and n >= max(LEAST_WORDS, LEAST_PERIODS * (1 if size == FIRST_BLOCK else size)):
        names = _names(x, live, size, names)
        order = np.argsort(names, kind="stable")
        bounds = np.searchsorted(names[order], np.arange(1, names.max(initial=0) + 2))
        blocks = np.array(live)
        again = blocks[order[bounds[names[blocks]] - 1] > blocks].tolist()
        for b in again:
            k = int(names[b])
            at = order[bounds[k - 1] : bounds[k]]
            lo, hi = np.searchsorted(at, (b + (1 if size == FIRST_BLOCK else size), b + 2 * size))
            for d in _distances(b, size, at[lo:hi], stretches) if size > FIRST_BLOCK else (at[lo:hi] - b).tolist():
                s, e = stretches.around(b, b + d + size, d)
                if e - s >= max(LEAST_WORDS, LEAST_PERIODS * d):
                    found.add((s, e - s, d))
        recur = set(again)
        live = [b for b in range(0, n - 2 * size + 1, 2 * size) if b in recur and b + size in recur]
        size *= 2
    return sorted((r for r in found if not any(np.array_equal(x[r[0] : r[0] + r[2]], x[r[0] + k : r[0] + k + r[2]]) for k in _divisors(r[2]))), key=lambda r: (r[0], r[2]))


def repeated(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words a run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) > 0


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def planted(doc_id: int | None, words: list[str]) -> list[str]:
    """The query's words: in a tenth of the documents the end repeats itself, as its contract says."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prepare: Callable[[object, list[str]], list[str]] | None = None) -> DataFrame:
    """Per row: id, n_words, runs (array of start, length, period), and ``collapsed``, the kept words joined by blanks.

    ``prepare`` may change a row's words, given its id, before the search.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, found, collapsed = batch.column(0), [], [], []
            for doc_id, text in zip(ids.to_pylist(), batch.column(1).to_pylist()):
                words = prepare(doc_id, words_of(text)) if prepare else words_of(text)
                number: dict[str, int] = {}
                x = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
                runs = find_runs(x)
                counts.append(len(words))
                found.append([{"start": s, "length": m, "period": q} for s, m, q in runs])
                collapsed.append(" ".join([words[i] for i in np.flatnonzero(~repeated(len(words), runs))] if runs else words))
            made = [pa.array(counts, pa.int64()), pa.array(found, _RUNS), pa.array(collapsed, pa.string())]
            yield pa.RecordBatch.from_arrays([ids, *made], ["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    made = rows.mapInArrow(run, f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return made.withColumnRenamed("id", id_col)


def op11_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, a tenth of them with planted repeats."""
    found = detect(table(spark, sf_dir, "documents"), prepare=planted)
    # floor(1000 * length / period) orders runs only roughly, so the ratio itself is compared: a / b > c / d as a * d > c * b
    better = lambda r, o: r["length"] * o["period"] > o["length"] * r["period"]
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", F.lit(0)), lambda a, r: F.when(better(r, a), r).otherwise(a))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
