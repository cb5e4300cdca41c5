"""Toxicity: noisy-channel deobfuscation, then a score over the restored words.

A token that looks obfuscated (letters mixed with digits or symbols, a letter three times in a row, or single letters
with separators between them) becomes a lattice: a character can stand for itself, for the letters LEET lists, be a
repetition or a separator to leave out, each at a cost. Viterbi search finds the cheapest word under a character trigram
model, which is counted over the words of all documents. Other tokens are taken as they stand, in lower case, without
the punctuation around them; those of digits and symbols alone are decoded as well. A run of single letters is split
at its wider gaps, and each piece is read as one word, as one word after a leading a or I, and as the cheapest row of
several words; all of these count, as does every word with a weight among its letters. Neighbouring tokens that make up a word with a weight count as that word.

From at most SAMPLE_ROWS labelled documents that aren't held out, those of the smallest hash of the id, words that are
significantly more frequent in toxic documents get log-odds weights (at most MAX_WORDS), and a logistic curve over the sum
of weights of a document's distinct restored words turns it into a score. No other column is an input of the score.

Null or empty text gets the score of a text without listed words; a document is held out if crc32 of its id as text
modulo 5 is 0 (a null id counts as empty text); ids may repeat; empty tables give an empty result; without labels of
both kinds nothing can be told apart and every score is 0.25; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ventura.llm.common import table

SAMPLE_ROWS, MAX_WORDS, FOLDS = 20_000, 2_000, 5
#: Letters that a character is used for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t", "|": "il", "(": "c", "€": "e"}
#: Costs of a letter for another character, of leaving out a letter of a run of three or more or of a pair, any character, a separator.
SUBSTITUTE, RUN, PAIR, DROP, SEPARATOR = 0.5, 0.3, 6.0, 9.0, 0.3
#: Raw tokens whose words a task holds.
CACHED = 100_000
#: Distinct words whose trigrams are counted at once.
COUNTED = 50_000
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_LETTER, _SIGN = re.compile("[a-z]"), re.compile("[0-9@$!+|(€]")
_RUN = re.compile(r"([a-z])\1\1|[a-z][.\-_*~'][a-z][.\-_*~']")
_SPACED = re.compile(r"(?<![^\W_])(?<![@$])(?:[^\W_]|[@$])(?:[ .\-_*~]{1,2}(?:[^\W_]|[@$])(?![^\W_]|[@$])){2,}")
_GAP = re.compile(r"[ .\-_*~]+")
_LEADING = re.compile(r"[@$!][a-z]{2}")
_PLAIN = re.compile(r"[a-z]+")
_LETTERLESS = re.compile(r"[0-9@$!+|(€]{3,}")
#: Fewest letters of a word that is joined from fragments, and most fragments.
JOINED, FRAGMENTS = 4, 4


def odd(token: str) -> bool:
    """Whether a token (lower case) looks obfuscated: letters with signs, runs, or letters with separators between them. Single scans."""
    return bool(_LETTER.search(token) and _SIGN.search(token) or _RUN.search(token))


class CharModel:
    """Trigram costs (negative log probabilities) over a-z and the word edge, with additive smoothing."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(27, 27, 27).astype(float)
        pair = (c.sum(axis=0) + 0.5) / (c.sum(axis=0).sum(axis=1, keepdims=True) + 13.5)
        self.cost = -np.log((c + 5.0 * pair[None]) / (c.sum(axis=2, keepdims=True) + 5.0))
        self.table = self.cost.tolist()

    def decode(self, observed: str, drops: bool = True) -> str:
        """The cheapest word behind the observed characters (lower case); without ``drops`` each of them is a letter."""
        states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        before = ""
        runs = {i for m in re.finditer(r"(.)\1\1+", observed, re.S) for i in range(m.start() + 1, m.end())}
        for at, ch in enumerate(observed):
            choices = [(ch, 0.0)] if "a" <= ch <= "z" else [(x, SUBSTITUTE) for x in LEET.get(ch, "")]
            drop = RUN if at in runs else PAIR if ch == before else DROP if ch.isalnum() or ch in LEET else SEPARATOR
            step: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (cost, out) in states.items():
                if drops and (not "a" <= ch <= "z" or ch == before):
                    held = step.get((a, b))
                    if held is None or cost + drop < held[0]:
                        step[a, b] = (cost + drop, out)
                row = self.table[a][b]
                for x, more in choices:
                    k = ord(x) - 96
                    total = cost + more + row[k]
                    held = step.get((b, k))
                    if held is None or total < held[0]:
                        step[b, k] = (total, out + x)
            states, before = step, ch
        return min((cost + self.table[a][b][0], out) for (a, b), (cost, out) in states.items())[1]


    def segment(self, observed: str) -> list[str]:
        """The cheapest row of words behind observed characters whose spaces say nothing (lower case); of one letter, only a and i."""
        # the letters so far are linked pairs, as a run may be long
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        before = ""
        runs = {i for m in re.finditer(r"(.)\1\1+", observed, re.S) for i in range(m.start() + 1, m.end())}
        for at, ch in enumerate(observed):
            choices = [(ch, 0.0)] if "a" <= ch <= "z" else [(x, SUBSTITUTE) for x in LEET.get(ch, "")]
            if not choices:
                continue
            step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, out) in states.items():
                if ch == before and b:
                    drop = cost + (RUN if at in runs else PAIR)
                    if (a, b) not in step or drop < step[a, b][0]:
                        step[a, b] = (drop, out)
                row = self.table[a][b]
                for x, more in choices:
                    k = ord(x) - 96
                    total = cost + more + row[k]
                    if (b, k) not in step or total < step[b, k][0]:
                        step[b, k] = (total, (out, x))
            ends = [(cost + self.table[a][b][0], (out, " ")) for (a, b), (cost, out) in step.items() if b and (a or b in (1, 9))]
            if ends:
                step[0, 0] = min(ends, key=lambda e: e[0])
            states, before = step, ch
        link = min(((cost + (self.table[a][b][0] if b else 0.0), out) for (a, b), (cost, out) in states.items()), key=lambda e: e[0])[1]
        letters = []
        while link:
            link, x = link
            letters.append(x)
        return "".join(reversed(letters)).split()


class Restorer:
    """Distinct restored words of a text, with a bounded memo over raw tokens; ``listed`` are words to join fragments to."""

    def __init__(self, model: CharModel, listed: Iterable[str] = ()):
        self.model, self.memo = model, {}
        self.listed = {w for w in listed if len(w) >= JOINED}
        self.begins = {w[:k] for w in self.listed for k in range(1, len(w))}

    def word(self, token: str) -> str:
        t = token.lower()
        core = t.strip(_EDGES)
        if core.isalpha() and not odd(core) and not _LEADING.match(t):
            return core
        # symbols at the edges can be letters of the word ($tupid), so they stay for decoding if they are in LEET
        own = t.strip("".join(c for c in _EDGES if c not in "@$!+|("))
        if re.fullmatch(r"[a-z]+[^a-z0-9]+", own):
            own = core
        return self.model.decode(own) if odd(own) else core

    def words(self, text: str) -> set[str]:
        if len(self.memo) > CACHED:
            self.memo = {}
        memo, out = self.memo, set()
        for token in set(text.split()):
            w = memo.get(token)
            if w is None:
                w = self.word(token)
                # most tokens are their own word: one string then
                w = memo[token] = token if w == token else w
            out.add(w)
            if _LETTERLESS.fullmatch(token):
                more = memo.get((token,))
                if more is None:
                    more = memo[token,] = {self.model.decode(token), self.model.decode(token, drops=False)}
                out |= more
        for m in _SPACED.finditer(text):
            out |= self.spaced(m.group().lower())
        if self.listed:
            out |= self.joined([memo[token] for token in text.split()])
        return out

    def spaced(self, run: str) -> set[str]:
        """Readings of a run of single letters: of the whole, and of its pieces between gaps wider than the narrowest."""
        gaps = _GAP.findall(run)
        least = min(map(len, gaps))
        pieces, last = [""], run[0]
        for ch, gap in zip(_GAP.split(run)[1:], gaps):
            pieces[-1] += last
            if len(gap) > least:
                pieces.append("")
            last = ch
        pieces[-1] += last
        out = {self.model.decode(run)}
        out |= self.within(self.model.decode("".join(pieces)))
        for piece in {*pieces, "".join(pieces)}:
            out.add(self.model.decode(piece))
            out.update(self.model.segment(piece))
            if piece[0] in "ai1" and len(piece) > 2:
                out.add(self.model.decode(piece[1:]))
                out.update(self.model.segment(piece[1:]))
        return out

    def within(self, letters: str) -> set[str]:
        """Listed words at any place among letters whose word edges are unknown."""
        out = set()
        for i in range(len(letters)):
            for k in range(i + 1, len(letters) + 1):
                w = letters[i:k]
                if w in self.listed:
                    out.add(w)
                if w not in self.begins:
                    break
        return out

    def joined(self, words: list[str]) -> set[str]:
        """Listed words that neighbouring fragments make up."""
        out = set()
        for i, w in enumerate(words):
            if w in self.begins:
                for k in range(i + 1, min(i + FRAGMENTS, len(words))):
                    w += words[k]
                    if w in self.listed:
                        out.add(w)
                    if w not in self.begins:
                        break
        return out


def trigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Trigram counts of one task's texts: code, n. Words are counted across batches, and at most COUNTED and one text's are held."""
    total = np.zeros(27**3, np.int64)
    counts: Counter[str] = Counter()

    def add() -> None:
        known = [(w, n) for w, n in ((w.strip(_EDGES), n) for w, n in counts.items()) if _PLAIN.fullmatch(w)]
        counts.clear()
        if not known:
            return
        # two edges before each word, one after: every trigram of the joined codes that begins inside a word counts
        flat = np.frombuffer(("".join(f"``{w}`" for w, _ in known)).encode(), np.uint8).astype(np.int64) - 96
        size = np.array([len(w) for w, _ in known])
        weight = np.repeat([n for _, n in known], size + 3)
        last = np.cumsum(size + 3) - 1
        code = flat[:-2] * 729 + flat[1:-1] * 27 + flat[2:]
        ok = np.ones(len(flat), bool)
        ok[last] = False
        ok[last - 1] = False
        np.add(total, np.bincount(code[ok[:-2]], weights=weight[:-2][ok[:-2]], minlength=27**3).astype(np.int64), out=total)

    for batch in batches:
        for text in batch["text"]:
            if text:
                counts.update(text.lower().split())
                if len(counts) > COUNTED:
                    add()
    add()
    at = np.flatnonzero(total)
    yield pd.DataFrame({"code": at, "n": total[at]})


def char_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigram counts over all words of a-z, summed by Spark; at most 27 cubed rows reach the driver."""
    made = docs.select(F.col(text_col).alias("text")).mapInPandas(trigrams, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    out = np.zeros(27**3, np.int64)
    for r in made.collect():
        out[r["code"]] = r["n"]
    return out


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    slope: float

    def total(self, words: set[str]) -> float:
        return sum(self.weights[w] for w in self.weights.keys() & words) if len(self.weights) < len(words) else sum(self.weights.get(w, 0.0) for w in words)

    def score(self, words: set[str]) -> float:
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.bias + self.slope * self.total(words)))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Bias and slope by Newton steps with a light ridge on the slope."""
    a = np.stack([np.ones_like(x), x], axis=1)
    beta = np.array([math.log((y.sum() + 1) / (len(y) - y.sum() + 1)), 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        h = a.T @ (a * (p * (1 - p))[:, None]) + np.diag([1e-6, 1e-2])
        step = np.linalg.solve(h, a.T @ (y - p) - np.array([0.0, 1e-2]) * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(max(0.0, beta[1]))


def train(docs: DataFrame, labels: DataFrame, model: CharModel, label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Weights and curve from labelled rows that aren't held out. The sampled ids are bounded, so they are broadcast."""
    picked = labels.select(F.col("doc_id").alias("id"), F.col(label_col).cast("int").alias("label")).dropna().filter(~held_out(F.col("id"))).dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id").select("id", "label", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Restorer(model)
        for batch in batches:
            seen: Counter[tuple[str, int]] = Counter()
            for label, text in zip(batch["label"], batch["text"]):
                seen.update((w, int(label)) for w in own.words(text or "") if w)
                seen["", int(label)] += 1
            yield pd.DataFrame({"word": [w for w, _ in seen], "label": [x for _, x in seen], "n": list(seen.values())})

    counts = rows.mapInPandas(count, "word string, label int, n long").groupBy("word").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("label") == 1, 0).otherwise(F.col("n"))).alias("good")
    )
    whole = counts.filter("word = ''").collect()
    bad, good = (whole[0]["bad"], whole[0]["good"]) if whole else (0, 0)
    if not bad or not good:
        return Model({}, math.log(1 / 3), 0.0)
    # one-sided two-proportion z over 4, so of a million words by chance some thirty pass
    p1, p0 = F.col("bad") / F.lit(float(bad)), F.col("good") / F.lit(float(good))
    mean = (F.col("bad") + F.col("good")) / F.lit(float(bad + good))
    z = (p1 - p0) / F.sqrt(mean * (1 - mean) * F.lit(1 / bad + 1 / good) + 1e-12)
    kept = counts.filter((F.col("word") != "") & (F.col("bad") >= 4)).withColumn("z", z).filter("z > 4").orderBy(F.desc("z"), "word").limit(MAX_WORDS).collect()
    weights = {r["word"]: math.log((r["bad"] + 0.5) / (bad + 1)) - math.log((r["good"] + 0.5) / (good + 1)) for r in kept}
    shape = Model(weights, 0.0, 1.0)

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Restorer(model, weights)
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"], "x": [shape.total(own.words(t or "")) for t in batch["text"]]})

    points = rows.mapInPandas(totals, "label int, x double").groupBy("label", "x").count().collect()
    x = np.repeat([p["x"] for p in points], [p["count"] for p in points])
    y = np.repeat([float(p["label"]) for p in points], [p["count"] for p in points])
    return Model(weights, *_logistic(x, y))


def score(docs: DataFrame, model: CharModel, judge: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score, predicted, n_listed (distinct restored words that have a weight)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Restorer(model, judge.weights)
        for batch in batches:
            found = [own.words(t or "") for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"].to_numpy(), "held_out": batch["held_out"].to_numpy(), "score": [judge.score(w) for w in found], "n_listed": [len(judge.weights.keys() & w) for w in found]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    made = rows.mapInPandas(run, "id long, held_out boolean, score double, n_listed long")
    return made.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_listed")


def keep_clean(docs: DataFrame, model: CharModel, judge: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` scored under 0.5, with their columns; the rows are judged where they are, without a join."""

    def verdicts(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Restorer(model, judge.weights)
        for batch in texts:
            # one text at a time leaves the batch
            yield pa.array([judge.score(own.words(t.as_py() or "")) < 0.5 for t in batch], pa.bool_())

    return docs.filter(F.arrow_udf(verdicts, "boolean")(F.col(text_col)))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[CharModel, Model]:
    model = CharModel(char_counts(docs))
    return model, train(docs, labels, model)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by a model learned from labels.toxic of those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, *fit(docs, table(spark, sf_dir, "labels")))
