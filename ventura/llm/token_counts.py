"""Token counts: a linear longest-match automaton gives greedy word-piece lengths without building pieces.

The vocabulary's byte strings form a trie. A failure link leads from a node to where matching goes on once the pieces
that are sure have been popped, and each node keeps only the number of pieces popped there, so a word costs one walk over
its bytes however often longest match would have to go back. Many words walk at once: their states are one array, moved
byte by byte through binary search over the sorted (node, byte) edges.

A word that the vocabulary cannot cover counts as one unknown piece. Null or empty text has no words and no tokens; rows
stand for themselves, so ids may repeat; an empty table gives an empty result; further columns are ignored. Memos of
distinct words and chunks are bounded.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ventura.llm.bpe import PATTERN, BytePairs
from ventura.llm.common import table

CACHED = 400_000


class LongestMatch:
    """Trie with failure links and popped-piece counts over byte pieces."""

    def __init__(self, pieces: Iterable[bytes]):
        children: list[dict[int, int]] = [{}]
        is_piece = [False]
        for piece in pieces:
            at = 0
            for b in piece:
                step = children[at].get(b)
                if step is None:
                    step = children[at][b] = len(children)
                    children.append({})
                    is_piece.append(False)
                at = step
            if at:
                is_piece[at] = True
        n = len(children)
        fail, popped = [-1] * n, [0] * n
        level = [0]
        while level:  # by depth, as a node's link needs those of shorter strings
            below = []
            for node in level:
                for b, child in children[node].items():
                    below.append(child)
                    if is_piece[child]:
                        fail[child], popped[child] = 0, 1
                        continue
                    z, count = fail[node], popped[node]
                    while z != -1 and b not in children[z]:
                        count += popped[z]
                        z = fail[z]
                    if z != -1:
                        fail[child], popped[child] = children[z][b], count
            level = below
        edges = sorted((node << 8 | b, child) for node, own in enumerate(children) for b, child in own.items())
        self.keys = np.array([k for k, _ in edges] or [-1], np.int64)
        self.targets = np.array([t for _, t in edges] or [-1], np.int64)
        self.fail, self.popped = np.array(fail, np.int64), np.array(popped, np.int64)

    def _step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = node << 8 | byte
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (node >= 0), self.targets[at], -1)

    def lengths(self, words: list[bytes]) -> np.ndarray:
        """Number of greedy pieces of each word; 1 for a word that can't be covered, 0 for an empty one."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        order = np.argsort(-size, kind="stable")  # longest first, so that those still walking are a prefix
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        start = np.cumsum(size) - size
        size, start = size[order], start[order]
        node, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
        lost = np.zeros(n, bool)
        walking = n
        for at in range(int(size[0]) if n else 0):
            walking = int(np.searchsorted(-size[:walking], -at, side="left"))
            todo = np.flatnonzero(~lost[:walking])
            byte = flat[start[todo] + at]
            while len(todo):
                step = self._step(node[todo], byte)
                ok = step >= 0
                node[todo[ok]] = step[ok]
                todo, byte = todo[~ok], byte[~ok]
                count[todo] += self.popped[node[todo]]
                node[todo] = self.fail[node[todo]]
                gone = node[todo] < 0
                lost[todo[gone]] = True
                todo, byte = todo[~gone], byte[~gone]
        rest = np.flatnonzero((node > 0) & ~lost)
        while len(rest):
            count[rest] += self.popped[node[rest]]
            node[rest] = self.fail[node[rest]]
            lost[rest[node[rest] < 0]] = True
            rest = rest[node[rest] > 0]
        count[lost] = 1
        out = np.empty(n, np.int64)
        out[order] = count
        return out


class TokenCounter:
    """Words and pieces of whole texts; words come from the pre-tokenising pattern."""

    def __init__(self, pieces: Iterable[bytes]):
        self.match = LongestMatch(pieces)
        self.pattern = regex.compile(PATTERN)
        self.uneven = regex.compile(r"\s\s| $|^ |\x00")
        self.chunks: dict[str, tuple[int, int]] = {}
        self.words: dict[str, int] = {}

    def _count(self, rows: list[list[str]]) -> list[tuple[int, int]]:
        if len(self.words) > CACHED:
            self.words = {}
        known = self.words
        new = list({w for row in rows for w in row if w not in known})
        if new:
            known.update(zip(new, self.match.lengths([w.encode() for w in new]).tolist()))
        return [(len(row), sum(map(known.__getitem__, row))) for row in rows]

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        """(words, pieces) of each text. Single spaces always begin a word, so chunks between them are memoised."""
        if len(self.chunks) > CACHED:
            self.chunks = {}
        known, out, rows = self.chunks, [], []
        for t in texts:
            row = [] if not t or self.uneven.search(t) else t.split(" ")
            if row:
                row[0] = "\x00" + row[0]
            rows.append(row)
        new = list({c for row in rows for c in row if c not in known})
        known.update(zip(new, self._count([self.pattern.findall(c[1:] if c[:1] == "\x00" else " " + c) for c in new])))
        for t, row in zip(texts, rows):
            if row or not t:
                own = [known[c] for c in row]
                out.append((sum(x for x, _ in own), sum(y for _, y in own)))
            else:
                out += self._count([self.pattern.findall(t)])
        return out


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    if path not in _counters:
        _counters[path] = TokenCounter(b for b in BytePairs(path).bytes if b)
    return _counters[path]


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = counter(vocabulary_path)
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.iloc[lo : lo + 512]
                made = own.count(["" if t is None else t for t in part["text"]])
                yield pd.DataFrame({"id": part["id"].to_numpy(), "n_words": [a for a, _ in made], "n_tokens": [b for _, b in made]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "id long, n_words long, n_tokens long").select(F.col("id").alias(id_col), "n_words", "n_tokens")


def op5_token_counts(spark: SparkSession, sf_dir: str, vocabulary_path: str | None = None) -> DataFrame:
    """All documents: words and greedy pieces over the strings of byte_bpe_50k."""
    if vocabulary_path is None:
        import public_tokenizers

        vocabulary_path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts(table(spark, sf_dir, "documents"), vocabulary_path)
