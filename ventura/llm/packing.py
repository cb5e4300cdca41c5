"""Sequence packing: order-preserving dynamic programming over document and sentence boundaries.

Rows of a scan partition are tokenised in their order and laid end to end. Windows of at most ``capacity`` tokens are
cut at document ends (free), sentence ends (SENTENCE_CUT) or, inside sentences of over HARD_STEP tokens, every HARD_STEP
tokens (HARD_CUT). The cuts minimise the sum of padding and cut penalties: cost[j] = penalty[j] + min over i of
cost[i] + padding(i, j). Padding is capacity - length, so the minimum over the sliding window of reachable i is the head
of a monotone queue of cost[i] + position[i]; a window whose length is a power of two carries no padding and is
looked up by its position. Blocks of BLOCK tokens bound the memory; the last windows of a block are handed on to the
next one. What remains at the end of a partition is cut into powers of two.

No shuffle: each task packs its own split, and sequence_id is (partition << 32) + number, the same when a lost task is
run again. Null or empty text has the closing id alone; ids may repeat, each row is a document of its own; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ventura.llm.common import table
from ventura.llm.hashing import SEED, SEED2, find_words, word_hashes
from ventura.llm.memo import HashMemo, Memo

CAPACITY, END_ID = 4096, 2
SENTENCE_CUT, HARD_CUT, HARD_STEP, SEQUENCE_COST = 8.0, 96.0, 256, 1.0
#: Windows of a power of two below this are left to the end of a partition.
LEAST_POWER = 256
BLOCK = 1 << 20
#: Documents encoded at a time: what their words need stands beside the memos in every worker.
ROWS = 512
CACHED_CHUNKS, CACHED_PIECES = 1_000_000, 300_000

_encoders: dict[str, ChunkEncoder] = {}


class ChunkEncoder:
    """Ids of texts by a lower-casing tokenizer that drops white space, such as word_bpe_49k.

    Two memos keep the tokenizer's work to distinct strings: chunks between blanks, known by two
    keyed 64-bit hashes of their bytes with A-Z lower-cased, and below them the pieces its pre-tokenizer makes of a chunk. Chunks with characters from U+0250
    on go to the tokenizer whole, and so do texts with ``<|``, where special tokens begin. A memo is emptied when it has
    grown beyond CACHED_CHUNKS or CACHED_PIECES entries.
    """

    #: The pre-tokenizer's pattern (a fixed value of the tokenizer file).
    PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.mark, self.mark_id = min((t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items())
        self.odd = re.compile("[^\x00-\u024f]")
        self.sentence_ids = np.array(sorted(i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>") and re.fullmatch(r"[.!?\"')]*[.!?][.!?\"')]*", t.removesuffix("</w>"))), dtype=np.int64)
        self.chunks, self.pieces = HashMemo(), Memo()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn_pieces(self, new: list[str]) -> None:
        # Pieces are joined by a special token, so one call gives the ids of many and that token's id parts them.
        for lo in range(0, len(new), 1024):
            part = new[lo : lo + 1024]
            ids = self._ids(self.mark.join(part))
            at = np.flatnonzero(ids == self.mark_id)
            self.pieces.add(part, np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1, np.delete(ids, at))

    def _learn(self, keys: np.ndarray, check: np.ndarray, text: list[str]) -> None:
        """Chunks by their keys, which are sorted."""
        joined = " ".join(text)
        rows = [self.PIECE.findall(c) for c in joined.lower().split(" ")]
        odd = [i for i, c in enumerate(text) if self.odd.search(c)] if self.odd.search(joined) else []
        for i in odd:
            rows[i] = []
        if len(self.pieces.at) > CACHED_PIECES:
            self.pieces = Memo()
        if unknown := set(chain.from_iterable(rows)).difference(self.pieces.at):
            self._learn_pieces(list(unknown))
        flat, ends = self.pieces.gather(rows)
        size = np.diff(ends, prepend=0)
        if odd:
            whole = [self._ids(text[i]) for i in odd]
            flat = np.insert(flat, np.repeat(ends[odd], [len(x) for x in whole]), np.concatenate(whole))
            size[odd] = [len(x) for x in whole]
        self.chunks.add(keys, check, size, flat)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.chunks) > CACHED_CHUNKS:
            self.chunks = HashMemo()
        special = {i for i, t in enumerate(texts) if "<|" in t}
        data, start, size, upto = find_words([b"" if i in special else t.encode().lower() for i, t in enumerate(texts)])
        hashes, check = (word_hashes(data, start, size, seed) for seed in (SEED, SEED2))
        keys, where, at = np.unique(hashes, return_index=True, return_inverse=True)
        new = self.chunks.missing(keys)
        if new.any():
            a, n = start[where[new]], size[where[new]]
            self._learn(keys[new], check[where[new]], [data[i:j].decode() for i, j in zip(a.tolist(), (a + n).tolist())])
        ids, ends, known = self.chunks.gather(keys, at)
        out = np.split(ids, np.concatenate([[0], ends])[upto][:-1]) if len(upto) else []
        # a text with two chunks of one key but different checks is left to the tokenizer
        special |= set(np.searchsorted(upto, np.flatnonzero(known != check), side="right").tolist())
        for i in special:
            out[i] = self._ids(texts[i])
        return out


def encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def cuts(ends: np.ndarray, sentences: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions a window may end at and their penalties, from document ends and sentence ends (0 is included)."""
    soft = np.union1d(ends, sentences)
    soft = np.union1d(soft, [0])
    gaps = np.diff(soft)
    wide = np.flatnonzero(gaps > HARD_STEP)
    hard = [np.arange(soft[i] + HARD_STEP, soft[i + 1], HARD_STEP) for i in wide]
    at = np.union1d(soft, np.concatenate(hard)) if hard else soft
    cost = np.full(len(at), HARD_CUT)
    cost[np.isin(at, sentences)] = SENTENCE_CUT
    cost[np.isin(at, ends)] = 0.0
    return at, cost


def windows(at: np.ndarray, penalty: np.ndarray, capacity: int = CAPACITY) -> list[int]:
    """Indexes into ``at`` of the cheapest cuts, first and last included."""
    m = len(at)
    lone: dict[int, list[int]] = {}
    k = LEAST_POWER
    while k < capacity:
        i = np.searchsorted(at, at - k)
        for j in np.flatnonzero((at >= k) & (at[np.minimum(i, m - 1)] == at - k)):
            lone.setdefault(int(j), []).append(int(i[j]))
        k *= 2
    pos, pen = at.tolist(), penalty.tolist()
    cost, back = [0.0] * m, [0] * m
    queue: deque[tuple[float, int]] = deque([(pos[0], 0)])
    for j in range(1, m):
        p = pos[j]
        while pos[queue[0][1]] < p - capacity:
            queue.popleft()
        best, i = queue[0]
        best += capacity - p
        for x in lone.get(j, ()):
            if cost[x] < best:
                best, i = cost[x], x
        best += pen[j] + SEQUENCE_COST
        cost[j], back[j] = best, i
        key = best + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    found = [m - 1]
    while found[-1]:
        found.append(back[found[-1]])
    return found[::-1]


def powers(size: int) -> list[int]:
    """Lengths that add up to ``size``, powers of two but for a last one under 64."""
    out = []
    while size >= 64:
        out.append(1 << (size.bit_length() - 1))
        size -= out[-1]
    return out + [size] * (size > 0)


class Packer:
    """Packs the documents of one partition as they come."""

    def __init__(self, base: int, sentence_ids: np.ndarray, capacity: int, with_ids: bool):
        self.next, self.sentence_ids, self.capacity, self.with_ids = base, sentence_ids, capacity, with_ids
        self.docs: list[tuple[object, int, int, np.ndarray]] = []  # id, tokens before, tokens of the document, ids left
        self.size = 0

    def add(self, doc_id: object, ids: np.ndarray) -> None:
        self.docs.append((doc_id, 0, len(ids), ids))
        self.size += len(ids)

    def flush(self, last: bool) -> list[tuple]:
        if not self.size:
            return []
        ids = np.concatenate([d[3] for d in self.docs])
        ends = np.cumsum([len(d[3]) for d in self.docs])
        at, cost = cuts(ends, np.flatnonzero(np.isin(ids, self.sentence_ids)) + 1)
        edges = at[windows(at, cost, self.capacity)]
        if last:
            tail = int(edges[-1] - edges[-2])
            if tail & (tail - 1) and tail < self.capacity:
                edges = np.concatenate([edges[:-1], edges[-2] + np.cumsum(powers(tail))])
        else:  # hand the last windows on
            edges = edges[edges <= max(edges[1], self.size - 2 * self.capacity)]
        out = self._pieces(ids, ends, edges)
        done = int(edges[-1])
        k = int(np.searchsorted(ends, done, side="right"))
        rest = self.docs[k:]
        if rest and (cut := done - int(ends[k - 1] if k else 0)):
            doc_id, start, total, own = rest[0]
            rest[0] = (doc_id, start + cut, total, own[cut:])
        self.docs, self.size = rest, self.size - done
        return out

    def _pieces(self, ids: np.ndarray, ends: np.ndarray, edges: np.ndarray) -> list[tuple]:
        marks = np.union1d(edges, ends[ends < edges[-1]])
        begins = np.concatenate([[0], ends[:-1]])
        lo, hi = marks[:-1], marks[1:]
        doc = np.searchsorted(ends, lo, side="right")
        window = np.searchsorted(edges, lo, side="right") - 1
        out = []
        for a, b, d, w in zip(lo.tolist(), hi.tolist(), doc.tolist(), window.tolist()):
            doc_id, start, total, _ = self.docs[d]
            piece = ids[a:b].astype("<u4")
            row = (doc_id, start + a - int(begins[d]), b - a, zlib.crc32(piece.tobytes()), total, self.next + w, a - int(edges[w]))
            out.append((*row, piece.astype(np.int64)) if self.with_ids else row)
        self.next += len(edges) - 1
        return out


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document: where it starts there, its length and checksum, its sequence and offset.

    ``with_ids`` adds the piece's token ids.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(tokenizer_path)
        packer = Packer(TaskContext.get().partitionId() << 32, own.sentence_ids, capacity, with_ids)
        columns = COLUMNS + ["ids"] * with_ids

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=columns)

        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                part = batch.iloc[lo : lo + ROWS]
                for doc_id, ids in zip(part["doc_id"].tolist(), own.encode(["" if t is None else t for t in part["text"]])):
                    packer.add(doc_id, np.append(ids, np.uint32(end_id)))
                if packer.size >= BLOCK and (rows := packer.flush(False)):
                    yield frame(rows)
        if rows := packer.flush(True):
            yield frame(rows)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = ", ".join(f"{c} long" for c in COLUMNS) + ", ids array<long>" * with_ids
    return rows.mapInPandas(run, schema)


def op6_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """All documents, packed into sequences of at most 4096 ids of word_bpe_49k."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return pack(table(spark, sf_dir, "documents"), tokenizer_path)
