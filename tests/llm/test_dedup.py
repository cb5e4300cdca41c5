import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.compare import connect, same
from tests.llm.helpers import AWKWARD, DIR, frame, input_dir
from ventura.llm import exact_dedup as E
from ventura.llm import line_dedup as L


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_binary_fuse_has_no_false_negatives(keys):
    f = E.BinaryFuse.from_bytes(E.BinaryFuse.build(np.array(sorted(keys), np.uint64)).to_bytes())
    assert f.contains(np.array(sorted(keys), np.uint64)).all()


def test_binary_fuse_false_positives_and_size():
    rng = np.random.default_rng(1)
    f = E.BinaryFuse.build(rng.integers(0, 2**63, 50_000).astype(np.uint64))
    assert f.contains(rng.integers(0, 2**63, 100_000).astype(np.uint64)).mean() < 0.006
    assert len(f.table) < 1.4 * 50_000


def expected(texts):
    rows = [(i, t or "", re.sub(r"[\x20\x09-\x0D]", "", t or "")) for i, t in texts]
    out = []
    for i, t, norm in rows:
        group = [(len(u), -(j if j is not None else -(10**9)), j) for j, u, m in rows if m == norm]
        out.append((i, max(group, key=lambda g: (g[0], g[1]))[2], len(group), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_oracle(spark):
    same(E.op2_exact_dedup(spark, DIR), connect(DIR), E.ORACLE)


def test_exact_awkward(spark, tmp_path):
    got = E.op2_exact_dedup(spark, input_dir(spark, tmp_path, frame(spark, AWKWARD)))
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got.collect()), key=str) == expected(AWKWARD)


def test_exact_weak_digest_is_saved_by_the_byte_check(spark):
    texts = [(i, f"text {i % 7}" + " " * (i % 3)) for i in range(900)]
    weak = lambda c: (F.length(c) % 2).cast("string")
    got = E.dedup(frame(spark, texts), F.col("doc_id") < 400, digest=weak, keys_per_bucket=2)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got.collect()), key=str) == expected(texts)


def test_exact_empty(spark, tmp_path):
    assert E.op2_exact_dedup(spark, input_dir(spark, tmp_path, frame(spark, []))).count() == 0


def brute_lines(spark, texts):
    """Chunks by Spark's own hashes, then first come first kept."""
    df = spark.createDataFrame([(i, t) for i, t in texts], "id long, text string")
    rows = df.select("id", F.xxhash64("text").alias("th"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    place = {}
    for r in L.chunks(rows).distinct().collect():
        lines = next(t for i, t in texts if i == r["id"]).split("\n")
        place.setdefault("\n".join(lines[r["start"] : r["start"] + r["n"]]), []).append((r["id"] is not None, r["id"] or 0, r["th"], r["start"], r["n"]))
    gone = {}
    for found in place.values():
        for _, i, _, start, n in sorted(set(found))[1:]:
            gone.setdefault(i, set()).update(range(start, start + n))
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i or 0, ())) for i, t in texts}


PASSAGE = "\n".join(f"shared line number {k} of a passage with some words in it" for k in range(12))
SHARED = [(i, f"own start {i}\n{'filler ' * i}\n{PASSAGE}\nown end {i}") for i in range(20, 60)]


def test_lines_match_brute_force(spark):
    texts = [x for x in AWKWARD if x[0] is not None] + SHARED + [(100, "a " * 60), (101, "z\n" + "a " * 60), (102, "\n\n\n\n"), (103, "\n\n\n\n")]
    got = {r["doc_id"]: r["text"] for r in L.dedup_lines(frame(spark, texts)).collect()}
    assert got == brute_lines(spark, texts)


def test_lines_remove_passages_and_leave_the_rest(spark):
    got = {r["doc_id"]: r["text"] for r in L.dedup_lines(frame(spark, SHARED)).collect()}
    assert got[20] == SHARED[0][1]
    removed = sum(len(t) for _, t in SHARED) - sum(len(t) for t in got.values())
    assert removed > 0.5 * 39 * len(PASSAGE)
    assert all(got[i].startswith(f"own start {i}\n") and f"own end {i}" in got[i] for i in got)


def test_lines_keep_columns_and_take_empty_tables(spark, tmp_path):
    docs = frame(spark, AWKWARD)
    out = L.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert L.dedup_lines(frame(spark, [])).count() == 0
    assert L.op3_line_dedup(spark, input_dir(spark, tmp_path, docs)).columns == ["doc_id", "text", "n_lines", "removed_lines", "removed_chunks"]


def test_lines_hot_passage_is_salted(spark):
    texts = [(i, f"head {i} x\n{PASSAGE}") for i in range(700)]
    out = L.dedup_lines(frame(spark, texts), report=True)
    assert out.filter("removed_lines > 0").count() == 699


def test_lines_short_passages_go_whole_wherever_they_stand(spark):
    """Passages of 50 to 80 words on 2 to 8 lines, each in documents with other neighbours and at other offsets."""
    passages = {(n, k): [" ".join(f"p{n}v{k}l{i}w{w}" for w in range(-(-(50 + 6 * k) // n))) for i in range(n)] for n in range(2, 9) for k in range(6)}
    own = lambda d, part: [f"own line {x} {part} of {d}" for x in range((7 * d) % 5 + 1)]
    texts = {}
    for lines in passages.values():
        for _ in range(3):
            d = len(texts)
            texts[d] = [own(d, "before"), lines, own(d, "after")]
    got = {r["doc_id"]: r["text"] for r in L.dedup_lines(frame(spark, [(d, "\n".join(sum(t, []))) for d, t in texts.items()])).collect()}
    assert got == {d: "\n".join(a + (b if d % 3 == 0 else []) + c) for d, (a, b, c) in texts.items()}


def test_lines_of_one_range_are_compared_chunk_by_chunk(spark, monkeypatch):
    """Where hashes can't tell lines apart, only chunks of equal bytes go."""
    weak = L.chunks
    monkeypatch.setattr(L, "chunks", lambda rows: weak(rows).withColumn("h", F.col("n").cast("long")))
    line = lambda name: " ".join(f"{name}{w}" for w in range(30))
    docs = frame(spark, [(1, f"{line('a')}\n{line('b')}"), (2, f"{line('a')}\n{line('b')}"), (3, f"{line('a')}\n{line('x')}")])
    got = {r["doc_id"]: r["text"] for r in L.dedup_lines(docs).collect()}
    assert got == {1: f"{line('a')}\n{line('b')}", 2: "", 3: f"{line('a')}\n{line('x')}"}
