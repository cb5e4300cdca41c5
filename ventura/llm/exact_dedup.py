"""Exact dedup: binary-fuse filters per immutable snapshot screen incoming digests before exact buckets are read.

A snapshot is frozen once: its distinct digests, dealt by digest to buckets, and one static 3-wise binary-fuse filter
per bucket (about 9 bits a key, 1/256 false positives). A later batch is first grouped within itself by digest. Its
distinct digests meet the filter of their bucket only (co-grouped by bucket; a digest comes once, so a group of copies
is one row there however large it is). Digests the filters let pass join the snapshot's exact bucket, which removes the
false positives. Every digest with more than one row then has the bytes of its rows compared with one representative:
the rows are dealt out by (digest, salt), with a copy of the representative for every SALT_ROWS rows, so a group that
holds a third of the table is spread over many tasks. Rows that differ from the representative, which a good digest
never gives, are grouped by the text itself.

Equal texts are those identical after every character of [\\x20\\x09-\\x0D] is deleted. The row with the most code points,
then the smallest id, stays. Null text counts as empty, ids may repeat (each row stays one row of the result, and
rows that tie in length and id are all marked kept), an empty table gives an empty result,
and further columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ventura.llm.common import BLANKS, cut, table

SALT_ROWS = 256
KEYS_PER_BUCKET = 100_000
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class BinaryFuse:
    """Static 3-wise binary-fuse filter over distinct 64-bit keys with 8-bit fingerprints, built by vectorised peeling."""

    def __init__(self, seed: int, segment: int, segments: int, table_: np.ndarray):
        self.seed, self.segment, self.segments, self.table = seed, segment, segments, table_

    @staticmethod
    def _slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
        h = _mix(keys + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
        first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
        a, b, c = _mix(h + np.uint64(1)), _mix(h + np.uint64(2)), _mix(h + np.uint64(3))
        mask = np.uint64(segment - 1)
        slots = np.stack([(first + np.uint64(k)) * np.uint64(segment) + (x & mask) for k, x in enumerate((a, b, c))])
        return slots.astype(np.int64), (h & np.uint64(0xFF)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        keys = np.unique(np.asarray(keys, dtype=np.uint64))
        n = len(keys)
        segment = 1 << max(2, int(np.log(max(n, 2)) / np.log(3.33) + 2.25))
        room = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 10)))) + 16
        segments = max(1, -(-room // segment))
        with np.errstate(over="ignore"):
            for seed in range(1, 200):
                slots, prints = cls._slots(keys, seed, segment, segments)
                size = (segments + 2) * segment
                order = cls._peel(slots, size)
                if order is not None:
                    break
                if seed % 8 == 0:
                    segments += max(1, segments // 8)
            else:
                raise RuntimeError("no peelable seed")
        out = np.zeros(size, dtype=np.uint8)
        for ids, own in reversed(order):
            s = slots[:, ids]
            value = prints[ids] ^ out[s[0]] ^ out[s[1]] ^ out[s[2]]
            out[own] = value  # the own slot is still 0 here
        return cls(seed, segment, segments, out)

    @staticmethod
    def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Rounds of (keys, their lone slots); None if a core remains. A round's lone slots touch no other key of it."""
        n = slots.shape[1]
        count = np.bincount(slots.ravel(), minlength=size)
        held = np.zeros(size, dtype=np.int64)
        for row in slots:
            np.bitwise_xor.at(held, row, np.arange(n))
        order, left = [], n
        lone = np.flatnonzero(count == 1)
        while left and len(lone):
            ids, at = np.unique(held[lone], return_index=True)
            order.append((ids, lone[at]))
            touched = slots[:, ids]
            np.subtract.at(count, touched.ravel(), 1)
            for row in touched:
                np.bitwise_xor.at(held, row, ids)
            left -= len(ids)
            lone = np.unique(touched.ravel())
            lone = lone[count[lone] == 1]
        return None if left else order

    def __contains__(self, key: int) -> bool:
        return bool(self.contains(np.array([key], dtype=np.uint64))[0])

    def contains(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            s, prints = self._slots(np.asarray(keys, dtype=np.uint64), self.seed, self.segment, self.segments)
        return (self.table[s[0]] ^ self.table[s[1]] ^ self.table[s[2]]) == prints

    def to_bytes(self) -> bytes:
        return struct.pack("<qqq", self.seed, self.segment, self.segments) + self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> BinaryFuse:
        return cls(*struct.unpack_from("<qqq", data), np.frombuffer(data, dtype=np.uint8, offset=24))


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _key(digest: Column) -> Column:
    return F.xxhash64(digest)


def snapshot(digests: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Freeze distinct digests (column digest): the exact buckets, and a row (bucket, filter) per bucket."""
    exact = digests.select("digest").distinct().withColumn("key", _key(F.col("digest"))).withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "filter": [BinaryFuse.build(pdf["key"].to_numpy().view(np.uint64)).to_bytes()]})

    return exact.select("digest", "bucket"), exact.select("bucket", "key").groupBy("bucket").applyInPandas(build, "bucket int, filter binary")


def screen(digests: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """Those of the distinct incoming digests that their bucket's filter lets pass."""

    def probe(batch: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(batch) or not len(own):
            return batch.iloc[:0][["digest"]]
        return batch[BinaryFuse.from_bytes(own["filter"].iloc[0]).contains(batch["key"].to_numpy().view(np.uint64))][["digest"]]

    keyed = digests.select("digest", _key(F.col("digest")).alias("key")).withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int"))
    return keyed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(probe, "digest string")


def _groups(rows: DataFrame) -> DataFrame:
    """Per digest: number of rows, and the best row as (-code points, id); combined before the shuffle."""
    return rows.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct((-F.col("cp")).alias("order"), F.col("id").alias("id"))).alias("best"))


def dedup(docs: DataFrame, is_snapshot: Column, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, keys_per_bucket: int = KEYS_PER_BUCKET) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    ``is_snapshot`` tells the rows frozen as a snapshot from the incoming batch; every row is in one of the two.
    """
    norm = normalised(F.col(text_col))
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(is_snapshot, F.lit(False)).alias("old"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("cp"), sha256(norm).alias("text_sha256"), digest(norm).alias("digest"))
    base = cut(base, "digests")
    old, new = _groups(base.filter("old")), _groups(base.filter("NOT old"))
    buckets = max(1, -(-base.count() // keys_per_bucket))
    exact, filters = snapshot(old, buckets)
    passed = screen(new, filters, buckets)
    positives = exact.join(passed, "digest", "left_semi")  # exact buckets decide; the filter's false positives end here
    # A digest is shared if the batch repeats it, the snapshot repeats it, or both have it.
    shared = cut(
        old.filter("n > 1").select("digest").unionByName(new.filter("n > 1").select("digest")).unionByName(positives.select("digest")).distinct().join(_groups(base), "digest"), "shared"
    )
    # Byte check of every row whose digest is shared, against its group's best row.
    texts = docs.select(F.col(id_col).alias("id"), norm.alias("norm"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("cp")).withColumn("digest", digest(F.col("norm")))
    salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
    # Shared digests grow with the table, so they are never broadcast: texts are dealt by digest, few go on.
    members = texts.join(shared.select("digest", "n", "best").hint("shuffle_hash"), "digest").withColumn("salt", F.pmod(F.xxhash64("id", "cp"), salts).cast("int"))
    members = cut(members, "members")
    lead = members.filter((F.col("id").eqNullSafe(F.col("best.id"))) & (F.col("cp") == -F.col("best.order")))
    lead = lead.groupBy("digest").agg(F.min("norm").alias("lead"), F.max("n").alias("n")).select("digest", "lead", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / SALT_ROWS).cast("int") - 1)).alias("salt"))
    checked = members.join(lead, ["digest", "salt"]).select("digest", "id", "cp", F.when(F.col("norm") != F.col("lead"), F.col("norm")).alias("other"))
    # ``other`` is null for rows equal to the lead; the rest are grouped by their own text.
    checked = cut(checked, "checked")
    groups = checked.groupBy("digest", "other").agg(F.count("*").alias("group_size"), F.min(F.struct((-F.col("cp")).alias("order"), F.col("id").alias("id"))).alias("best"))
    odd = checked.filter("other IS NOT NULL").select("digest", "id", "cp", "other").distinct()
    lone = groups.filter("other IS NULL").select("digest", "group_size", "best")
    out = base.join(lone, "digest", "left")
    apart = odd.join(groups.filter("other IS NOT NULL"), ["digest", "other"]).select("digest", "id", "cp", F.sha2("other", 256).alias("text_sha256"), F.col("group_size").alias("size2"), F.col("best").alias("best2"))
    out = out.join(apart, ["digest", "id", "cp", "text_sha256"], "left")
    own = F.struct((-F.col("cp")).alias("order"), F.col("id").alias("id"))
    out = out.select("id", "cp", "text_sha256", F.coalesce("size2", "group_size", F.lit(1)).cast("long").alias("group_size"), F.coalesce("best2", "best", own).alias("best"))
    return out.select(F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), "group_size", (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("cp") == -F.col("best.order"))).alias("kept"), "text_sha256")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: the lower half of the id range is the frozen snapshot, the rest the incoming batch."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ends = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    middle = 0 if ends["lo"] is None else (ends["lo"] + ends["hi"]) // 2
    return dedup(docs, F.col("doc_id") <= middle)


ORACLE = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, arg_min(doc_id, (-cp, doc_id)) AS keep_id FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.norm) AS text_sha256 FROM t JOIN g ON t.norm = g.norm
"""
