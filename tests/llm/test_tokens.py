import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.helpers import AWKWARD, DIR, frame, input_dir
from ventura.llm import bpe, packing, token_counts

MORE = [(50, "trail  \n\n x"), (51, "aaaaaaaa aaa"), (52, " a"), (53, "a "), (54, "x\x00y z"), (55, "a \nb"), (56, "don't we'll <|startoftext|>y"), (57, "...!!! 123456 a1b2")]


def test_bpe_equals_the_library(spark, tmp_path):
    texts = AWKWARD + MORE
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        assert back == (text or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    got = bpe.op7_bpe(spark, input_dir(spark, tmp_path, frame(spark, texts)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_bpe_on_the_table(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    for r in bpe.encode(spark.read.parquet(f"{DIR}/documents.parquet"), path).join(spark.read.parquet(f"{DIR}/documents.parquet"), "doc_id").collect():
        assert list(r["ids"]) == t.encode(r["text"] or "", add_special_tokens=False).ids and r["decoded"] == (r["text"] or "")


def greedy(word, vocab, most):
    n = i = 0
    while i < len(word):
        size = next((k for k in range(min(most, len(word) - i), 0, -1) if word[i : i + k] in vocab), 0)
        if not size:
            return 1
        n, i = n + 1, i + size
    return n


def test_longest_match_equals_greedy():
    rng = random.Random(0)
    for _ in range(150):
        vocab = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 14))) for _ in range(40)] + [b""]
        assert token_counts.LongestMatch(vocab).lengths(words).tolist() == [greedy(w, vocab, 5) for w in words]


def test_token_counts_equal_brute_force(spark, tmp_path):
    texts = AWKWARD + MORE
    path = public_tokenizers.path("byte_bpe_50k.json")
    vocab = {b for b in bpe.BytePairs(path).bytes if b}
    most, pattern = max(map(len, vocab)), __import__("regex").compile(bpe.PATTERN)
    want = []
    for i, t in texts:
        words = pattern.findall(t or "")
        want.append((i, len(words), sum(greedy(w.encode(), vocab, most) for w in words)))
    got = token_counts.op5_token_counts(spark, input_dir(spark, tmp_path, frame(spark, texts)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def check_packing(rows, texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    padding = total = 0
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
        total, padding = total + at, padding + (0 if at & (at - 1) == 0 else 4096 - at)
    for i, text in texts:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        own = sorted(by_doc[i], key=lambda r: (r["start"], r["length"]))
        copies = sum(r["start"] == 0 for r in own)
        assert sum(r["length"] for r in own) == copies * len(ids)
        for r in own:
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    return padding, total


def test_packing_awkward(spark, tmp_path):
    texts = AWKWARD + MORE
    rows = packing.op6_packing(spark, input_dir(spark, tmp_path, frame(spark, texts).coalesce(1))).collect()
    check_packing(rows, texts)


def test_packing_table_has_little_padding(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rows = packing.op6_packing(spark, "/root/testdata/sf0.01").collect()
    padding, total = check_packing(rows, docs)
    assert padding < 0.02 * total


def test_windows_are_optimal():
    rng = random.Random(3)
    for _ in range(40):
        at = np.array(sorted(rng.sample(range(1, 900), 30)), np.int64)
        at, cost = np.concatenate([[0], at]), np.array([0.0] + [rng.choice([0.0, 8.0]) for _ in range(30)])
        best = [0.0] + [float("inf")] * 30
        for j in range(1, 31):
            for i in range(j):
                n = int(at[j] - at[i])
                if n <= 300:
                    pad = 0 if n & (n - 1) == 0 and n >= packing.LEAST_POWER else 300 - n
                    best[j] = min(best[j], best[i] + pad + cost[j] + packing.SEQUENCE_COST)
        if best[-1] == float("inf") or max(np.diff(at)) > 300:
            continue
        cut = packing.windows(at, cost, 300)
        spent = 0.0
        for i, j in zip(cut, cut[1:]):
            n = int(at[j] - at[i])
            spent += (0 if n & (n - 1) == 0 and n >= packing.LEAST_POWER else 300 - n) + cost[j] + packing.SEQUENCE_COST
        assert abs(spent - best[-1]) < 1e-9


def test_empty(spark, tmp_path):
    d = input_dir(spark, tmp_path, frame(spark, []))
    assert packing.op6_packing(spark, d).count() == bpe.op7_bpe(spark, d).count() == token_counts.op5_token_counts(spark, d).count() == 0


#: Two words that polynomial hashes modulo 2**64 give one value, whatever the base.
PARITY = "".join("ab"[i.bit_count() % 2] for i in range(1024))
COLLIDING = (PARITY, PARITY.translate(str.maketrans("ab", "ba")))


def test_packing_tells_colliding_words_apart():
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    for order in (COLLIDING, COLLIDING[::-1]):
        own = packing.ChunkEncoder(path)
        texts = [*order, " ".join(order), f"{order[1]} x {order[0]}"]
        for text, ids in zip(texts, [*own.encode(texts[:1]), *own.encode(texts[1:])]):
            assert ids.tolist() == t.encode(text, add_special_tokens=False).ids


def test_memo_of_chunks_stays_small():
    """Every worker keeps up to a million chunks: at most 28 bytes each beside their ids."""
    from ventura.llm.memo import HashMemo

    memo, rng = HashMemo(), np.random.default_rng(2)
    want = {}
    for _ in range(5):
        keys = np.unique(rng.integers(0, 1 << 62, 1000).astype(np.uint64))
        keys = keys[memo.missing(keys)]
        size = rng.integers(0, 4, len(keys))
        flat = rng.integers(0, 49_000, size.sum()).astype(np.uint32)
        memo.add(keys, keys + np.uint64(1), size, flat)
        want |= dict(zip(keys.tolist(), map(np.ndarray.tolist, np.split(flat, np.cumsum(size)[:-1]))))
    keys = np.array(sorted(want), np.uint64)
    at = rng.integers(0, len(keys), 5000)
    ids, ends, check = memo.gather(keys, at)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [want[k] for k in keys[at].tolist()] and (check == keys[at] + np.uint64(1)).all()
    assert sum(a.nbytes for a in (memo.keys, memo.check, memo.slot, memo.start, memo.size)) <= 28 * len(memo)
