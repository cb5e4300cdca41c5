"""Keyed hashes of words and of runs of words, for code inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: The keys of all hashes, an odd step, and the multipliers of ``mix``.
SEED, SEED2, STEP, M1, M2 = np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes that are hashed at once.
BATCH_BYTES = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit and is not linear."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def find_words(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts end to end, and of the words between the blanks [\\x20\\x09-\\x0D] the first byte, the number of bytes and the number of words up to the end of each text."""
    data = b"\n".join([b"", *texts, b"        "])
    inside = ~BLANK[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    ends = np.cumsum([1] + [len(t) + 1 for t in texts])[1:]
    return data, edges[::2], edges[1::2] - edges[::2], np.searchsorted(edges[::2], ends)


def word_hashes(data: bytes, start: np.ndarray, size: np.ndarray, seed: np.uint64 = SEED) -> np.ndarray:
    """Hashes of the words that ``find_words`` found.

    A word is read in steps of eight bytes, each mixed into its hash, which begins with its length: words of one length up
    to eight bytes never collide, longer ones as any 64-bit hash does.
    """
    eight = np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))
    hashes = seed ^ size.astype(np.uint64)
    left = np.arange(len(start))
    with np.errstate(over="ignore"):
        done = 0
        while len(left):
            rest = size[left] - done
            chunk = eight[start[left] + done]
            cut = rest < 8
            chunk[cut] &= (np.uint64(1) << (rest[cut] * 8).astype(np.uint64)) - np.uint64(1)
            hashes[left] = mix(hashes[left] * STEP + chunk)
            left = left[rest > 8]
            done += 8
    return hashes


class ShingleHasher:
    """Sorted distinct hashes of the runs of n words of texts, A-Z lower-cased. A text of fewer than n words is one run."""

    def __init__(self, n: int):
        self.n = n

    def sets(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        part: list[bytes] = []
        size = 0
        for t in texts:
            part.append(t.encode().lower() if t else b"")
            size += len(part[-1])
            if size > BATCH_BYTES:
                yield from self._batch(part)
                part, size = [], 0
        yield from self._batch(part)

    def _batch(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        if not texts:
            return
        n = self.n
        *found, upto = find_words(texts)
        words = word_hashes(*found)
        count = max(0, len(words) - n + 1)
        grams = words[:count]
        with np.errstate(over="ignore"):
            for k in range(1, n):
                grams = mix(grams * STEP + words[k : k + count])
            begin = 0
            for end in upto.tolist():
                if end - begin >= n:
                    yield np.unique(grams[begin : end - n + 1])
                elif end > begin:
                    whole = np.array([end - begin], np.uint64)
                    for h in words[begin:end]:
                        whole = mix(whole * STEP + h)
                    yield whole
                else:
                    yield grams[:0]
                begin = end
