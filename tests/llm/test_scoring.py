import random
import re
import tracemalloc
import zlib
from collections import Counter

import pandas as pd
import pytest

from tests.llm.helpers import AWKWARD, DIR, frame, input_dir, labels
from ventura.llm import license_scan, quality_rules, toxicity


def brute_stats(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


REPEATS = [(70, "a b c d e " * 4), (71, "x y z w v u x y z w v q"), (72, "one two three four five six seven eight nine ten eleven\n" * 3), (73, "$$$ ### | | <a> & %*"), (74, "fine words here that do not repeat at all in any way so it stays kept")]


def test_quality_statistics(spark, tmp_path):
    texts = AWKWARD + REPEATS
    d = input_dir(spark, tmp_path, frame(spark, texts), labels(spark, [(74, 1, 0), (None, 0, None)]))
    got = quality_rules.op10_quality_rules(spark, d).collect()
    want = []
    for i, t in texts:
        n, chars, symbols, dup, rep = brute_stats(t)
        failed = n < 10 or 100 * rep > 20 * n
        want.append((i, n, chars, symbols, dup, rep, failed, not failed))
    assert sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in got), key=str) == sorted(want, key=str)


def test_quality_on_the_table(spark):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    for r in quality_rules.op10_quality_rules(spark, DIR).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_stats(text[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


def test_quality_rules_learn_and_keep(spark):
    d = "/root/testdata/sf0.1"
    docs, marks = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality_rules.op10_quality_rules(spark, d)
    met = got.join(marks, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in met}
    assert n[0, False] > 0.9 * (n[0, False] + n.get((0, True), 0))
    # good rows go only by the base rule
    assert got.join(marks, "doc_id").filter("quality = 1 AND NOT kept AND NOT base_failed").count() <= 0.002 * n[1, True]
    kept = quality_rules.keep_good(docs, quality_rules.learn(quality_rules.labelled_sample(docs, marks, 1 - marks["quality"])))
    assert kept.columns == docs.columns and kept.count() == got.filter("kept").count()


def test_quality_empty(spark, tmp_path):
    assert quality_rules.op10_quality_rules(spark, input_dir(spark, tmp_path, frame(spark, []), labels(spark, []))).count() == 0


@pytest.fixture(scope="module")
def fitted(spark):
    d = "/root/testdata/sf0.1"
    docs, marks = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    return toxicity.fit(docs, marks), docs, marks


def test_toxicity_held_out(spark, fitted):
    (chars, model), docs, marks = fitted
    rows = toxicity.score(docs, chars, model).join(marks, "doc_id").filter("held_out").collect()
    hit = Counter((r["toxic"], r["predicted"]) for r in rows)
    assert hit[1, 1] > 0.85 * (hit[1, 0] + hit[1, 1]) and hit[0, 0] > 0.98 * (hit[0, 0] + hit[0, 1])
    assert all(0 <= r["score"] <= 1 and (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_toxicity_deobfuscation(fitted):
    (chars, _), _, _ = fitted
    own = toxicity.Restorer(chars)
    for raw, word in [("1d10t", "idiot"), ("m0r0n", "moron"), ("stuuupid", "stupid"), ("s.t.u.p.i.d", "stupid"), ("i d i o t", "idiot"), ("p@thetic", "pathetic"), ("CL0WN", "clown"), ("tr4sh", "trash"), ("l0ser,", "loser")]:
        assert word in own.words(f"the {raw} of"), raw
    assert own.words("plain words, stay as-is.") >= {"plain", "words", "stay"}


def test_trigrams_of_many_words_in_little_memory():
    """Counts by one scan per word, and memory that does not follow a batch's distinct words."""
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=12)) for _ in range(60)) for _ in range(3000)] + [None, "", "Don't (stop) it,", "it it 4"]
    want: Counter[int] = Counter()
    for token in (t for text in texts for t in (text or "").lower().split()):
        w = token.strip(toxicity._EDGES)
        if re.fullmatch("[a-z]+", w):
            codes = [0, 0, *(ord(c) - 96 for c in w), 0]
            want.update(a * 729 + b * 27 + c for a, b, c in zip(codes, codes[1:], codes[2:]))
    batches = [pd.DataFrame({"text": texts[k : k + 1600]}) for k in (0, 1600)]
    tracemalloc.start()
    made = pd.concat(toxicity.trigrams(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made.groupby("code")["n"].sum().to_dict() == want
    assert peak < 70e6


def test_toxicity_spaced_sentences_and_fragments(fitted):
    (chars, model), _, _ = fitted
    own = toxicity.Restorer(chars, {"stupid", "idiot"})
    cases = [
        ("y o u  i d i o t", {"you", "idiot"}), ("y o u i d i o t", {"idiot"}), ("you are a s t u p i d fool", {"stupid", "fool"}), ("I h a t e this", {"hate"}),
        ("a s s", {"ass"}), ("455 and @$$", {"ass", "455"}), ("so st upid", {"stupid"}), ("an id iot.", {"idiot"}), ("s-t-u-p-i-d  i-d-i-o-t", {"stupid", "idiot"}),
    ]
    for text, words in cases:
        assert own.words(text) >= words, (text, own.words(text))
    assert "idiot" not in own.words("idi of ot")
    assert own.words("s " * 20_000)


def test_toxicity_awkward(spark, tmp_path, fitted):
    d = input_dir(spark, tmp_path, frame(spark, AWKWARD), labels(spark, [(4, 1, 1), (5, 1, 0), (8, None, None), (None, 1, 1)]))
    got = toxicity.op4_toxicity(spark, d)
    assert got.count() == len(AWKWARD) and got.filter("score IS NULL OR score < 0 OR score > 1 OR held_out IS NULL").count() == 0
    (chars, model), _, _ = fitted
    clean = toxicity.keep_clean(frame(spark, [*AWKWARD, (90, "you idiot scum moron clown"), (91, "you 1d10t $cum m0r0n cl0wn")]), chars, model)
    assert sorted(map(str, (r["doc_id"] for r in clean.collect()))) == sorted(str(i) for i, _ in AWKWARD)


def test_toxicity_empty(spark, tmp_path):
    assert toxicity.op4_toxicity(spark, input_dir(spark, tmp_path, frame(spark, []), labels(spark, []))).count() == 0


LICENSED = [
    (80, "Licensed under the Apache License, Version 2.0."),
    (81, "x MIT License y mit-license\nGNU General, Public License CC BY cc by"),
    (82, "lead " * 100 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction" + " tail" * 50),
    (83, "ALL rights reserved. mitlicense xmit license"),
]


def brute_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places, base = [], set()
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places, base = places + at, base | ({label} if at else set())
    best, found = 0.0, set()
    for label, t in license_scan.TEMPLATES.items():
        own, size = set(t.split()), len(t.split())
        for s in range(0, len(words), size):
            share = len(own & set(words[s : s + 2 * size])) / len(own)
            if share >= 0.8 - 1e-9:
                best, found = max(best, share), found | {license_scan.LABELS.get(label, label)}
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if places else best


def test_license_scan(spark, tmp_path):
    texts = AWKWARD + LICENSED
    got = license_scan.op9_license_scan(spark, input_dir(spark, tmp_path, frame(spark, texts)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((i, *brute_scan(t)) for i, t in texts), key=str)


def test_license_scan_on_the_table(spark):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = license_scan.op9_license_scan(spark, "/root/testdata/sf0.01").collect()
    assert sum(r["n_base"] > 0 for r in rows) > 5
    assert all(tuple(r)[1:] == brute_scan(text[r["doc_id"]]) for r in rows)


def test_license_empty(spark, tmp_path):
    assert license_scan.op9_license_scan(spark, input_dir(spark, tmp_path, frame(spark, []))).count() == 0


def test_long_unbroken_tokens_are_scanned_once():
    import time

    from ventura.llm import toxicity

    began = time.time()
    assert not toxicity.odd("1" * 1_000_000) and not toxicity.odd("日" * 1_000_000) and toxicity.odd("a" + "1" * 1_000_000)
    assert time.time() - began < 5


def test_license_filters_lose_nothing_and_rule_out():
    """Length, prefix and positional filters against plain counts on random blocks: no miss, and each rules some out."""
    rng = random.Random(5)
    t = license_scan.Template("x", tuple(sorted(rng.sample(range(60), 20))), 16, 20)
    kept, ruled_out, by_place = 0, 0, 0
    for _ in range(4000):
        block = sorted(set(rng.sample(t.ranks, rng.randint(8, 20))) | set(rng.sample(range(60), rng.randint(0, 10))))
        share = len(set(t.ranks) & set(block))
        assert t.overlap(block) == (share if share >= t.need else 0)
        assert share < t.need or t.may_meet(block)
        kept += share >= t.need
        ruled_out += not t.may_meet(block)
        by_place += t.may_meet(block) and not t.overlap(block)
    assert kept > 100 and ruled_out > 100 and by_place > 100


def test_whole_notices_and_their_parts(spark, tmp_path):
    """A whole notice is found with some words lost or replaced, and not where under four fifths are left."""
    words = license_scan.TEMPLATES["isc"].split()
    texts = [(0, "lead in " + " ".join(words) + " and more"), (1, " ".join(words[::2])), (2, "x " * 40 + " ".join(w for k, w in enumerate(words) if k % 12) + " y" * 40)]
    got = {r["doc_id"]: r["labels"] for r in license_scan.op9_license_scan(spark, input_dir(spark, tmp_path, frame(spark, texts))).collect()}
    assert "isc" in got[0] and "isc" not in got[1] and "isc" in got[2]
