"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. A round looks up all adjacent pairs of unfinished words by binary
search over the sorted pair keys, finds each word's lowest rank, and merges that pair's occurrences in the word, left to
right; words without a known pair leave. Words come from the vocabulary's pre-tokenising pattern; distinct words and
distinct space-free chunks are encoded once per worker and kept in bounded memos.

Texts equal to what the tokenizers library gives with add_special_tokens=False: the strings of special tokens inside a
text are cut out first and become their ids. Null or empty text has no tokens; rows stand for themselves, so ids may
repeat; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ventura.llm.common import table
from ventura.llm.memo import Memo

CACHED_CHUNKS, CACHED_WORDS = 250_000, 400_000
#: The byte-level pre-tokenising pattern (a fixed value of the file format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SHIFT = np.int64(20)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, by character."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class BytePairs:
    """Merge tables of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab, alphabet = data["model"]["vocab"], byte_alphabet()
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes[i] = bytes(alphabet[c] for c in token) if i not in self.special.values() else token.encode()
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.byte_ids = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.byte_ids[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = (left << _SHIFT) | right
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.decimal = [str(i) for i in range(len(self.bytes))]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words end to end, and the number of ids of each."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(n), size)
        done_ids: list[np.ndarray] = []
        done_words: list[np.ndarray] = []
        worst = len(self.keys)
        while len(symbols):
            pair = np.flatnonzero(word[1:] == word[:-1])
            keys = (symbols[pair] << _SHIFT) | symbols[pair + 1]
            at = np.minimum(np.searchsorted(self.keys, keys), worst - 1)
            rank = np.where(self.keys[at] == keys, self.ranks[at], worst)
            # lowest rank of each word
            low = np.full(n, worst, np.int64)
            if len(pair):
                first = np.flatnonzero(np.diff(word[pair], prepend=-1))
                low[word[pair[first]]] = np.minimum.reduceat(rank, first)
            over = low[word] == worst
            if over.any():
                done_ids.append(symbols[over])
                done_words.append(word[over])
            hit = (rank == low[word[pair]]) & (rank < worst)
            places = pair[hit]
            made = self.made[at[hit]]
            # of overlapping occurrences (a a a) every second one of a run is taken
            run = np.cumsum(np.diff(places, prepend=-2) != 1)
            start = np.flatnonzero(np.diff(run, prepend=0))
            odd = (np.arange(len(places)) - start[run - 1]) % 2 == 0 if len(places) else np.zeros(0, bool)
            places, made = places[odd], made[odd]
            symbols = symbols.copy()
            symbols[places] = made
            keep = ~over
            keep[places + 1] = False
            symbols, word = symbols[keep], word[keep]
        ids, owner = np.concatenate(done_ids or [symbols]), np.concatenate(done_words or [word])
        order = np.argsort(owner, kind="stable")
        return ids[order].astype(np.uint32), np.bincount(owner, minlength=n)


class Codec:
    """Encodes and decodes batches of texts; memos are emptied beyond their bounds."""

    def __init__(self, path: str):
        self.pairs = BytePairs(path)
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.pairs.special)) + ")") if self.pairs.special else None
        #: A space next to other white space, or characters that mark the memo's keys: such texts are parted by the pattern.
        self.uneven = regex.compile(r"\s\s| $|^ |\x00")
        self.chunks, self.words = Memo(), Memo()

    def _learn(self, new: list[str]) -> None:
        """Chunks: what stands between single spaces, with its space in front, or without one if \\x00 stands there."""
        rows = [self.pattern.findall(c[1:] if c[:1] == "\x00" else " " + c) for c in new]
        ids, ends = self._words(rows)
        self.chunks.add(new, np.diff(ends, prepend=0), ids)

    def _words(self, rows: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words.at) > CACHED_WORDS:
            self.words = Memo()
        if unknown := sorted(set(chain.from_iterable(rows)).difference(self.words.at)):
            ids, size = self.pairs.merge([w.encode() for w in unknown])
            self.words.add(unknown, size, ids)
        return self.words.gather(rows)

    def _uneven(self, text: str) -> np.ndarray:
        parts: list[np.ndarray] = []
        for piece in self.special.split(text) if self.special else [text]:
            if piece in self.pairs.special:
                parts.append(np.array([self.pairs.special[piece]], np.uint32))
            elif piece:
                parts.append(self._words([self.pattern.findall(piece)])[0])
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.chunks.at) > CACHED_CHUNKS:
            self.chunks = Memo()
        odd = {i for i, t in enumerate(texts) if self.uneven.search(t) or (self.special and self.special.search(t))}
        rows = []
        for i, t in enumerate(texts):
            row = [] if i in odd or not t else t.split(" ")
            if row:
                row[0] = "\x00" + row[0]
            rows.append(row)
        if new := sorted(set(chain.from_iterable(rows)).difference(self.chunks.at)):
            self._learn(new)
        ids, upto = self.chunks.gather(rows)
        out = np.split(ids, upto[:-1]) if len(upto) else []
        for i in odd:
            out[i] = self._uneven(texts[i])
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.pairs.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 and decoded_sha256, and with ``with_ids`` the ids and the decoded text."""
    kept = ["ids", "decoded"] * with_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(tokenizer_path)
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.iloc[lo : lo + 256]
                ids = own.encode(["" if t is None else t for t in part["text"]])
                text = [own.decode(x) for x in ids]
                number = own.pairs.decimal.__getitem__
                made = {
                    "id": part["id"].to_numpy(),
                    "n_tokens": [len(x) for x in ids],
                    "ids_sha256": [hashlib.sha256(",".join(map(number, x.tolist())).encode()).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in text],
                }
                if with_ids:
                    made |= {"ids": [x.astype(np.int64) for x in ids], "decoded": text}
                yield pd.DataFrame(made)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * with_ids
    return rows.mapInPandas(run, schema).select(F.col("id").alias(id_col), "n_tokens", "ids_sha256", "decoded_sha256", *kept)


def op7_bpe(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """All documents by byte_bpe_50k: number and digest of ids, digest of the text decoded from them."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    return encode(table(spark, sf_dir, "documents"), tokenizer_path, with_ids=False)
