"""N-gram Jaccard join: set relations skip work in an exact similarity join of shingle sets.

A document's set holds the 64-bit hashes of its distinct word n-grams. Links (Jaccard >= threshold) are found exactly:

1. Equal sets are one node, named by the smallest id, so a group of copies never meets itself.
2. A set is cut into m parts by ranges of the hash, m being more than the d shingles that it and a linked one can differ in, so
   two linked sets have at least m - d parts in common, each of several shingles: unrelated texts don't share one by a phrase that
   both use, however many texts there are. A part is one token. Tokens have one order, parts of many shingles before those of few, so
   the prefix filter is exact: the first d + 1 tokens of each of two linked sets share one. m is fixed for a level, some size
   classes in a row; a set of the lowest class of a level also has tokens by the level below. Below PARTS_FROM a part would
   hold too few shingles. There the tokens are the shingles, rare before frequent: classes of document frequency, from a sketch of
   2**SKETCH_BITS counters over all documents (a fixed size), then the hash; the first |x| - ceil(t|x|) + 1 of each share one.
   Tokens of prefixes make inverted lists; those of one entry go.
3. Leaders, a linear number of comparisons. In each list and size class the entry with the fewest tokens before it leads, and
   in lists of LED_ROWS and more the entry of the smallest hash does too. Each node is compared with one leader of either kind, the one it shares most lists
   with. A comparison also gives the node's difference from its leader, the shingles that only one of them has.
4. What is left are lists with more than one component. Lists of more than BLOCK_ROWS are cut into blocks by size class
   (ratio 1/t) and position (POSITION_BLOCK); a block meets blocks of its own and the next size class alone, skips those at
   positions where too few tokens are left. Entries of a list's most frequent component skip each other. Pairs must pass sizes, positions,
   parity bitmaps (they bound how many shingles two sets differ in) and the triangle inequality: two nodes whose differences
   from a common leader are too far apart in number cannot link. If more pairs than nodes are left, the most promising pair
   of every two components is compared first, and then those whose components that has not joined.
5. Nodes that were compared with the same leader get their answers from the leader's: the sets differ in
   |dx| + |dy| - 2|dx & dy| shingles, dx and dy being their differences from the leader, so no set is fetched. Other
   pairs are compared by their whole sets. Nothing is capped.

Components by these links equal components by all links, as only pairs that are already connected or cannot link are
left out. Two different words of over eight bytes are taken as equal if their 64-bit keyed hashes are, and so are shingles; for any
two of m different ones anywhere that has a chance of m^2 / 2^65. Null or empty text has an empty set and no links (its
component is its own id); a text of fewer words than n is one shingle; rows without an id link with nothing; rows that
repeat an id are joined; an empty table gives an empty result; further columns are ignored. Documents are named by whole
numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ventura.llm.common import cut, free, lookup, table
from ventura.llm.hashing import STEP, ShingleHasher, mix

SKETCH_BITS, CHUNK, POSITION_BLOCK, BLOCK_ROWS = 20, 1024, 8, 64
#: Least threshold at which sets are cut into parts, and how far the sizes of one level may be apart.
PARTS_FROM, LEVEL_RATIO = Fraction(3, 4), Fraction(7, 5)
#: A list or group of more than 1 in HOT_SHARE of all rows (and HOT_ROWS) is dealt out over several tasks; there are fewer than
#: HOT_SHARE of these at every size, so they are broadcast.
HOT_SHARE, HOT_ROWS = 4096, 256
#: Fewest bits of a set's bitmap. A shingle flips one, so two bitmaps differ in at most as many bits as the sets in shingles.
BITMAP = 1024
#: Words of the short bitmap that entries of lists carry, folded from the whole one.
SHORT = 4
SHORT_BITS = tuple(f"s{k}" for k in range(SHORT))
SHORT_DIFFER = " + ".join(f"bit_count(x.{c} ^ y.{c})" for c in SHORT_BITS)
#: Of a pair of nodes x and y, the ids and roots in order.
ENDS = ("least(x.id, y.id) AS a", "greatest(x.id, y.id) AS b", "least(x.root, y.root) AS ra", "greatest(x.root, y.root) AS rb")
#: Fewest entries of a list that has a leader of each kind; the one of a shorter list counts as both.
LED_ROWS = 8
#: Blocks of one list that meet in one task.
STRIPE = 64
#: Most ids that are broadcast to filter a scan.
SEMI_ROWS = 2_000_000


def size_classes(t: Fraction) -> np.ndarray:
    """Least size of each class; linked sets are in one class or in neighbouring ones."""
    least = [1]
    while least[-1] < 1 << 40 and t < 1:
        least.append(least[-1] * t.denominator // t.numerator + 1)
    return np.array(least, np.int64)


class Parts:
    """Prefixes by parts of sets: tokens that two sets of Jaccard ``t`` or more share, unless they are equal."""

    def __init__(self, t: Fraction):
        self.t, self.least, self.held = t, size_classes(t), {}
        # classes of a level; neighbouring ones differ by 1/t
        self.step = 1
        while t < 1 and t ** (self.step + 1) * LEVEL_RATIO >= 1:
            self.step += 1

    def most(self, size: int) -> int:
        """Most shingles that a set of ``size`` and a linked one of as many or more differ in."""
        return size * (self.t.denominator - self.t.numerator) // self.t.numerator

    def level(self, k: int) -> tuple[int, np.ndarray, np.ndarray]:
        """Most shingles that linked sets differ in if the smaller one is of level ``k``; first hash of each part but the first; seeds of the parts."""
        if k not in self.held:
            d = self.most(int(self.least[(k + 1) * self.step]) - 1)
            # spare parts, so that empty ones and the smallest stay behind the prefix
            m = d + 1 + max(1, d // 16)
            edges = np.array([(i << 64) // m for i in range(1, m)], np.uint64)
            with np.errstate(over="ignore"):
                self.held[k] = d, edges, mix((np.arange(m, dtype=np.uint64) + np.uint64(k << 40)) * STEP)
        return self.held[k]

    def tokens(self, s: np.ndarray) -> list[np.ndarray]:
        """Prefix of the set's own level and of the one below, where it can link with sets of that; ``s`` is sorted."""
        d = self.most(len(s))
        if not d:
            return [s[:0], s[:0]]
        sc = int(np.searchsorted(self.least, len(s), side="right")) - 1
        upto = np.zeros(len(s) + 1, np.uint64)
        np.cumsum(s, out=upto[1:])
        out = []
        for k in (sc // self.step, sc // self.step - 1 if sc % self.step == 0 else -1):
            far, edges, seeds = self.level(k) if k >= 0 else (0, s[:0], s[:0])
            if not far:  # sets that link with equal ones alone
                out.append(s[:0])
                continue
            ends = np.concatenate(([0], np.searchsorted(s, edges), [len(s)]))
            first = np.argsort(ends[:-1] - ends[1:], kind="stable")[: min(d, far) + 1]
            with np.errstate(over="ignore"):
                out.append(mix(upto[ends[first + 1]] - upto[ends[first]] + seeds[first]))
        return out


def bitmap_bits(least: int) -> int:
    """Bits for the sets of a size class of at least ``least`` shingles."""
    return max(BITMAP, 1 << (4 * least - 1).bit_length())


def _list_column(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(a) for a in arrays])
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))


def frequency_classes(docs: DataFrame, n: int) -> np.ndarray:
    """Class of document frequency of each of the sketch's counters, counted over all documents (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total, held, size = ShingleHasher(n), np.zeros(1 << SKETCH_BITS, np.int64), [np.zeros(0, np.uint64)], 0

        def count() -> np.ndarray:
            return np.bincount((np.concatenate(held) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)

        for batch in batches:
            for s in own.sets(batch.column("text").to_pylist()):
                held.append(s)
                size += len(s)
                if size > 1 << 20:
                    total += count()
                    held, size = held[:1], 0
        total += count()
        # a row per CHUNK counters: small numbers, which shrink well
        flat = pa.array(total.astype(np.int64))
        counts = pa.ListArray.from_arrays(pa.array(np.arange(0, len(total) + 1, CHUNK, dtype=np.int32)), flat)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total) // CHUNK, dtype=np.int32)), counts], ["chunk", "counts"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": group["chunk"].iloc[:1], "counts": [np.sum(np.stack(group["counts"].to_list()), axis=0)]})

    kind = "chunk int, counts array<long>"
    made = docs.mapInArrow(run, kind).groupBy("chunk").applyInPandas(add, kind).toArrow()
    total = np.zeros((1 << SKETCH_BITS) // CHUNK * CHUNK).reshape(-1, CHUNK)
    for k, counts in zip(made["chunk"].to_pylist(), made["counts"].combine_chunks()):
        total[k] = counts.values.to_numpy()
    total = total.ravel()
    return np.clip(np.floor(np.log2((total + 1) / (total.mean() + 1)) * 2), 0, 60).astype(np.uint8)


def prefixes(docs: DataFrame, n: int, t: Fraction, classes: np.ndarray | None) -> DataFrame:
    """id, size and size class of the set, its 128-bit key, its prefixes in the global order (the second one by the level below) and its parity bitmap."""
    least = size_classes(t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts = ShingleHasher(n), Parts(t)
        for batch in batches:
            sizes, k1, k2, heads, below, bits, short = [], [], [], [], [], [], []
            for s in own.sets(batch.column("text").to_pylist()):
                with np.errstate(over="ignore"):
                    k1.append(s.sum(dtype=np.uint64))
                k2.append(np.bitwise_xor.reduce(s))
                sizes.append(len(s))
                width = bitmap_bits(int(least[np.searchsorted(least, max(1, len(s)), side="right") - 1]))
                odd = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1
                bits.append(np.packbits(odd).view(np.uint64))
                short.append(np.bitwise_xor.reduce(bits[-1].reshape(-1, SHORT), axis=0))
                if classes is None:
                    head, low = parts.tokens(s)
                else:
                    order = np.argsort(classes[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
                    head, low = s[order[: len(s) + (-t.numerator * len(s)) // t.denominator + 1]] if len(s) else s, s[:0]
                heads.append(head)
                below.append(low)
            size = np.array(sizes, np.int64)
            sc = np.searchsorted(least, size, side="right") - 1 if t < 1 else size
            made = [batch.column("id"), pa.array(size), pa.array(sc.astype(np.int32)), pa.array(np.array(k1, np.uint64).view(np.int64)), pa.array(np.array(k2, np.uint64).view(np.int64)), _list_column(heads), _list_column(below), _list_column(bits)]
            made += [pa.array(c) for c in np.array(short, np.uint64).view(np.int64).reshape(-1, SHORT).T.copy()]
            yield pa.RecordBatch.from_arrays(made, ["id", "size", "sc", "k1", "k2", "prefix", "below", "bits", *SHORT_BITS])

    return docs.mapInArrow(run, "id long, size long, sc int, k1 long, k2 long, prefix array<long>, below array<long>, bits array<long>, " + ", ".join(f"{c} long" for c in SHORT_BITS))


def picked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` whose id is in ``ids``. Up to SEMI_ROWS ids are broadcast to filter the scan; beyond that both are dealt by id."""
    return rows.join(F.broadcast(ids) if ids.count() <= SEMI_ROWS else ids.hint("shuffle_hash"), "id", "left_semi")


def differences(docs: DataFrame, pairs: DataFrame, n: int, most: Fraction) -> DataFrame:
    """Exact comparison of pairs (a, b) of ids: a, b, size_a, size_b, common and, up to ``most`` of the sizes' sum, delta.

    The followers a of one b are dealt to tasks with a copy of b's text for each task and stream past its set. Every b also meets
    itself once.
    """
    total = pairs.count()
    hot = pairs.groupBy("b").agg(F.count("*").alias("n")).filter(F.col("n") > max(HOT_ROWS, total // HOT_SHARE)).select("b", F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("salts"))
    salted = pairs.join(F.broadcast(hot), "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    want = salted.select(F.col("a").alias("id"), "b", "salt", F.lit(0).alias("leads")).unionByName(salted.select(F.col("b").alias("id"), "b", "salt", F.lit(1).alias("leads")).distinct())
    ids = cut(want.select("id").distinct(), "wanted")
    rows = picked(docs, ids).join(want.hint("merge"), "id").repartition("b", "salt").sortWithinPartitions("b", "salt", F.desc("leads"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at, lead = ShingleHasher(n), None, []
        for batch in batches:
            out: list[tuple] = []
            deltas: list[np.ndarray | None] = []
            columns = (batch.column(c).to_pylist() for c in ("id", "b", "salt", "leads"))
            for i, b, salt, leads, s in zip(*columns, own.sets(batch.column("text").to_pylist())):
                if (b, salt) != at:
                    at, lead = (b, salt), []
                if leads:
                    lead.append(s)
                for y in lead:
                    if leads and (salt or len(lead) > 1):
                        continue
                    common = len(s) + len(y) - len(np.union1d(s, y)) if s is not y else len(s)
                    out.append((i, b, len(s), len(y), common))
                    far = len(s) + len(y) - 2 * common
                    deltas.append(np.setxor1d(s, y, assume_unique=True) if far * most.denominator <= (len(s) + len(y)) * most.numerator else None)
            columns = [pa.array([r[k] for r in out], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([None if d is None else d.view(np.int64) for d in deltas], pa.list_(pa.int64()))], ["a", "b", "size_a", "size_b", "common", "delta"])

    made = cut(rows.select("id", "b", "salt", "leads", "text").mapInArrow(run, "a long, b long, size_a long, size_b long, common long, delta array<long>"), "compared")
    free(ids)
    return made


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node but the roots, the smallest of their components, for edges (a, b).

    A node of one edge hangs on its neighbour and takes no part in the rest, so a hub of many such nodes is no hot key. Between
    the others, large-star and small-star steps alternate until nothing changes.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    ends = e.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(e.select(F.col("b").alias("node"), F.col("a").alias("to")))
    leaf = ends.groupBy("node").agg(F.count("*").alias("n"), F.min("to").alias("to")).filter("n = 1")
    # an edge of two such nodes is a component; else one of its ends hangs on the other
    leaf = leaf.groupBy(F.greatest("node", "to").alias("a"), F.least("node", "to").alias("b")).agg(F.count("*").alias("n"), F.min("node").alias("node"), F.min("to").alias("to"))
    leaf = cut(leaf.select("a", "b", F.when(F.col("n") == 2, F.col("a")).otherwise(F.col("node")).alias("node"), F.when(F.col("n") == 2, F.col("b")).otherwise(F.col("to")).alias("to")), "leaves")
    core, spare, before = cut(e.join(leaf.hint("merge"), ["a", "b"], "left_anti"), "core"), e, None
    while True:
        now = tuple(core.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == before or not now[0]:
            break
        before = now
        both = core.unionByName(core.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least.hint("merge"), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        core, spare = cut(small, over=spare), core
    # a leaf can be smaller than the root of its neighbour: the smallest node names the component
    hung = lookup(leaf.select("node", "to"), "to", core.select(F.col("a").alias("to"), F.col("b").alias("top")), F.col("node")).select("node", F.coalesce("top", "to").alias("top"))
    every = cut(hung.unionByName(core.select(F.col("a").alias("node"), F.col("b").alias("top"))), over=spare)
    named = every.groupBy("top").agg(F.min("node").alias("least")).select("top", F.least("least", "top").alias("root"))
    made = lookup(every, "top", named, F.col("node")).select("node", "root").unionByName(named.select(F.col("top").alias("node"), "root"))
    made = cut(made.filter("node <> root"), "roots")
    free(every, leaf, core)
    return made


class _Join:
    """State of one join: the nodes, their lists, the links and components so far."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, lists: DataFrame, n: int, t: Fraction):
        self.docs, self.nodes, self.lists, self.n, self.t, self.parts = docs, nodes, lists, n, t, t >= PARTS_FROM
        self.compared: list[DataFrame] = []
        self.derived: list[DataFrame] = []
        self.roots: DataFrame | None = None

    def linked(self, differ: str, sizes: str) -> str:
        """Condition that sets that differ in ``differ`` shingles link, or could if that is a bound."""
        num, den = self.t.numerator, self.t.denominator
        return f"({differ}) * {num + den} <= ({sizes}) * {den - num}"

    def may_link(self, a: str, b: str) -> str:
        """Size and positional filters of two entries of a list."""
        num, den = self.t.numerator, self.t.denominator
        # of the first token that sets share, those before it are parts that differ, or shingles of one set alone
        if self.parts:
            first = self.linked(f"greatest({a}.pos, {b}.pos)", f"{a}.size + {b}.size")
        else:
            first = f"least({a}.size - {a}.pos, {b}.size - {b}.pos) * {num + den} >= ({a}.size + {b}.size) * {num}"
        return f"least({a}.size, {b}.size) * {den} >= greatest({a}.size, {b}.size) * {num} AND {first}"

    def leader_pairs(self) -> DataFrame:
        """Each node with two leaders: of the central and of the random leaders of its lists, the one it shares most lists with."""
        entry = F.struct(F.xxhash64("id").alias("h"), "id", "size", "pos")
        lead = self.lists.groupBy("token", "salt", "sc").agg(F.max("n").alias("n"), F.min(F.struct("pos", F.xxhash64("id").alias("h"), "id", "size")).alias("c"), F.min(entry).alias("r"))
        one = lambda c, central, random: F.struct(f"{c}.id", f"{c}.size", f"{c}.pos", F.lit(central).alias("central"), F.lit(random).alias("random"))
        kinds = F.when((F.col("n") < LED_ROWS) | (F.col("c.id") == F.col("r.id")), F.array(one("c", 1, 1))).otherwise(F.array(one("c", 1, 0), one("r", 0, 1)))
        lead = lead.select("token", "salt", F.explode(F.array("sc", F.col("sc") - 1)).alias("sc"), kinds.alias("kinds")).select("token", "salt", "sc", F.inline("kinds"))
        met = self.lists.alias("x").join(lead.alias("y").hint("merge"), F.expr(f"x.token = y.token AND x.salt = y.salt AND x.sc = y.sc AND x.id <> y.id AND {self.may_link('x', 'y')}"))
        shared = met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), "y.central", "y.random").groupBy("a", "b").agg(F.sum("central").alias("central"), F.sum("random").alias("random"))
        most = lambda c: F.max(F.when(F.col(c) > 0, F.struct(c, F.xxhash64("b").alias("h"), "b"))).alias(c)
        best = shared.groupBy("a").agg(most("central"), most("random"))
        pairs = best.select("a", F.explode(F.array_distinct(F.array_compact(F.array("central.b", "random.b")))).alias("b"))
        # the short bitmaps first: few pairs are left for the whole ones. Some leaders have very many pairs.
        own = self.nodes.select("id", "size", *SHORT_BITS)
        pairs = pairs.join(own.select(F.col("id").alias("a"), F.struct("size", *SHORT_BITS).alias("x")).hint("merge"), "a")
        pairs = lookup(pairs, "b", own.select(F.col("id").alias("b"), F.struct("size", *SHORT_BITS).alias("y")), F.col("a"))
        return self.screened(cut(pairs.filter(self.linked(SHORT_DIFFER, "x.size + y.size")).select("a", "b"), "met"))

    def screened(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b and further columns; a result of ``cut``) whose whole bitmaps allow a link."""
        ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
        own = cut(picked(self.nodes.select("id", "size", "bits"), ids), "bits")
        rows = pairs.join(own.select(F.col("id").alias("a"), F.struct("size", "bits").alias("x")).hint("merge"), "a")
        rows = rows.join(own.select(F.col("id").alias("b"), F.struct("size", "bits").alias("y")).hint("merge"), "b")
        made = cut(rows.filter(self.linked(_differ("x.bits", "y.bits"), "x.size + y.size")).select(*pairs.columns), "pairs")
        free(pairs, ids, own)
        return made

    def reference(self, hubs: DataFrame) -> DataFrame:
        """Per node the hub that its difference is known from: of itself, if it has followers, and the one it was compared with, that of more followers."""
        c = hubs.filter("delta IS NOT NULL")
        counted = lookup(c.select("a", "b"), "b", c.groupBy("b").agg(F.count("*").alias("n")), F.col("a"))
        one = counted.groupBy("a").agg(F.max(F.struct("n", (F.col("a") == F.col("b")).alias("own"), "b"))["b"].alias("b"))
        found = c.join(one.hint("merge"), ["a", "b"]).groupBy("a").agg(F.first("b").alias("ref"), F.first("delta").alias("delta"), F.first("size_a").alias("size"), F.first("size_b").alias("lead"), F.count("*").alias("n")).filter("n = 1")
        return found.select(F.col("a").alias("id"), "ref", "delta", "size", "lead")

    def rooted(self, rows: DataFrame) -> DataFrame:
        """``rows`` (id and further columns) with the root of the id's component."""
        return rows.join(self.roots.withColumnRenamed("node", "id").hint("merge"), "id", "left").withColumn("root", F.coalesce("root", "id"))

    def mixed(self, p: DataFrame, by: str) -> DataFrame:
        """Lists of ``p`` in which the column ``by`` has several values, with the most frequent one: token, salt, main."""
        most = F.max(F.struct("size", by))[by].alias("main")
        tokens = p.groupBy("token", by).agg(F.count("*").alias("size"), F.max("salts").alias("salts")).groupBy("token").agg(most, F.count("*").alias("several"), F.max("salts").alias("salts"))
        return tokens.filter("several > 1").select("token", "main", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))

    def hub_pairs(self) -> DataFrame:
        """Each node of a list of LED_ROWS and more with several components, with the root of the one that is largest in most of its lists, its hub.

        If that root has a hub of more followers itself, the node follows this one: nodes of two hubs would meet in their lists.
        """
        p = self.lists.filter(F.col("n") >= LED_ROWS).join(self.rooted(self.nodes.select("id")).hint("merge"), "id")
        met = p.select("id", "token", "salt").join(self.mixed(p, "root").hint("merge"), ["token", "salt"]).groupBy("id", "main").agg(F.count("*").alias("n"))
        best = cut(met.groupBy("id").agg(F.max(F.struct("n", "main"))["main"].alias("b")).filter("id <> b"), "best")
        groups = best.groupBy("b").agg(F.count("*").alias("n"))
        above = lookup(groups.join(best.select(F.col("id").alias("b"), F.col("b").alias("up")).hint("merge"), "b"), "up", groups.select(F.col("b").alias("up"), F.col("n").alias("more")), F.col("b"))
        above = above.filter("struct(more, up) > struct(n, b)").select("b", "up")
        made = cut(lookup(best, "b", above, F.col("id")).select(F.col("id").alias("a"), F.coalesce("up", "b").alias("b")).filter("a <> b"), "hubs")
        free(best)
        return made

    def close_differences(self, refs: DataFrame) -> DataFrame:
        """Pairs of different components and one hub whose differences from it may have enough in common: a, b, their roots, the hub and a slack.

        The sets differ in |dx| + |dy| - 2|dx & dy| shingles, so a link needs a least number of common ones, as one of the two
        isn't linked with the hub. That is a prefix filter: shingles that few of the hub's followers differ in come first, and those of
        one follower alone make no list.
        """
        num, den = self.t.numerator, self.t.denominator
        r = self.rooted(refs.withColumn("far", F.size("delta"))).withColumn("near", F.expr(self.linked("far", "size + lead")))
        apart = r.filter("NOT near").select("ref").distinct().withColumn("open", F.lit(True))
        r = lookup(r, "ref", apart, F.col("id")).filter("open").drop("open").withColumn("most", F.expr(f"size * {den - num} div {num}"))
        # fewest common shingles with any node that can link: of a node linked with the hub, with those that are not
        least = F.expr(f"IF(near, CAST(floor((far * {num + den} - (size - lead) * {den - num}) / {2 * (num + den)}) AS LONG) + 1, 1)")
        r = r.withColumn("low", F.col("far") - F.greatest(F.col("far") - F.expr("most div 2"), least)).withColumn("high", F.col("far") - F.greatest(F.col("far") - F.col("most"), least))
        r = cut(r.select("ref", "id", "size", "far", "near", "root", "low", "high", "delta"), "followers")
        each = r.select("ref", "id", F.explode("delta").alias("token"))
        shared = each.groupBy("ref", "token").agg(F.count("*").alias("n")).filter("n > 1")
        own = Window.partitionBy("id")
        at = each.join(shared.hint("merge"), ["ref", "token"]).select("id", "token", F.row_number().over(own.orderBy("n", "token")).alias("k"), F.count("*").over(own).alias("held"))
        at = at.join(r.drop("delta").hint("merge"), "id").withColumn("pos", F.col("far") - F.col("held") + F.col("k") - 1).filter("pos <= high").drop("k", "held", "high")
        at = cut(at, "shared")
        meet = (
            "x.ref = y.ref AND x.token = y.token AND x.root <> y.root AND NOT (x.near AND y.near) AND struct(y.far, y.id) < struct(x.far, x.id)"
            f" AND {self.linked('x.far + y.far - 2 * least(x.far - x.pos, y.far - y.pos)', 'x.size + y.size')}"
        )
        met = at.alias("x").join(at.filter("pos <= low").alias("y").hint("merge"), F.expr(meet))
        made = met.selectExpr(*ENDS, "x.ref", "0D AS slack").distinct()
        made = cut(made.join(self.seen().hint("merge"), ["a", "b"], "left_anti"), "close")
        free(r, at)
        return made

    def plausible(self, refs: DataFrame) -> DataFrame:
        """Pairs of different components and hubs that share a list and pass all filters: a, b, their roots, no hub and how much they seem to differ."""
        num, den = self.t.numerator, self.t.denominator
        state = self.rooted(self.nodes.select("id", *SHORT_BITS)).join(refs.select("id", "ref").hint("merge"), "id", "left")
        # entries of one kind don't meet: those of one hub do by their differences, those of one component need not
        state = cut(state.withColumn("kind", F.struct(F.col("ref").isNotNull().alias("led"), F.coalesce("ref", "root").alias("by"))), "state")
        p = self.lists.join(state.hint("merge"), "id")
        rows = F.collect_list(F.struct("id", "sc", F.col("size").cast("int").alias("size"), "pos", "root", "ref", "kind", *SHORT_BITS)).alias("rows")
        whole = p.filter(F.col("n") <= BLOCK_ROWS).groupBy("token").agg(rows, F.mode("kind", True).alias("main"), F.min("kind").alias("least"), F.max("kind").alias("last")).filter("least <> last")
        whole = whole.select(F.expr("filter(rows, r -> r.kind <> main)").alias("xs"), F.expr("filter(rows, r -> r.kind = main)").alias("mains"))
        whole = whole.select("xs", F.inline(F.array(F.struct(F.col("xs").alias("ys"), F.lit(True).alias("own")), F.struct(F.col("mains").alias("ys"), F.lit(False).alias("own")))))
        large = p.filter(F.col("n") > BLOCK_ROWS)
        large = large.join(self.mixed(large, "kind").hint("merge"), ["token", "salt"])
        deal = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK_ROWS)).cast("int")
        blocks = large.groupBy("token", "sc", F.floor(F.col("pos") / POSITION_BLOCK).alias("pb"), deal.alias("deal"), (F.col("kind") == F.col("main")).alias("main")).agg(
            rows, F.max("n").alias("n"), F.min("size").alias("least"), F.max(F.col("size") - F.col("pos")).alias("rest"), F.max("size").alias("most"), F.min("pos").alias("first")
        )
        blocks = cut(blocks, "blocks")
        stripes = F.ceil(F.col("n") / (BLOCK_ROWS * STRIPE)).cast("int")
        x = blocks.withColumn("stripe", F.pmod(F.xxhash64("deal"), stripes).cast("int")).alias("x")
        y = blocks.select("*", F.explode(F.sequence(F.lit(0), stripes - 1)).alias("stripe")).select("*", F.explode(F.array("sc", F.col("sc") - 1)).alias("meets")).alias("y")
        left = self.linked("greatest(x.first, y.first)", "x.most + y.most") if self.parts else f"least(x.rest, y.rest) * {num + den} >= (x.least + y.least) * {num}"
        meet = (
            "x.token = y.token AND x.sc = y.meets AND x.stripe = y.stripe AND NOT (x.main AND y.main)"
            " AND (x.sc <> y.sc OR struct(x.pb, x.deal, x.main) <= struct(y.pb, y.deal, y.main))"
            f" AND {left} AND x.least * {num} <= y.most * {den} AND y.least * {num} <= x.most * {den}"
        )
        same = F.expr("x.sc = y.sc AND x.pb = y.pb AND x.deal = y.deal AND x.main = y.main")
        met = whole.unionByName(x.join(y.hint("merge"), F.expr(meet)).select(F.col("x.rows").alias("xs"), F.col("y.rows").alias("ys"), same.alias("own")))
        pairs = met.select("xs", "own", F.explode("ys").alias("y")).select(F.explode("xs").alias("x"), "y", "own").filter("NOT own OR x.id < y.id")
        pairs = pairs.filter(F.expr(f"x.root <> y.root AND x.kind <> y.kind AND {self.may_link('x', 'y')}")).filter(F.expr(self.linked(SHORT_DIFFER, "x.size + y.size")))
        pairs = pairs.selectExpr(*ENDS, "CAST(NULL AS LONG) AS ref", f"({SHORT_DIFFER}) / (x.size + y.size) AS slack")
        drawn = cut(pairs.distinct().join(self.seen().hint("merge"), ["a", "b"], "left_anti"), "drawn")
        free(state, blocks)
        return self.screened(drawn)

    def seen(self) -> DataFrame:
        """Pairs that have been compared."""
        out = None
        for c in self.compared + self.derived:
            own = c.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            out = own if out is None else out.unionByName(own)
        return out.distinct()

    def derive(self, pairs: DataFrame, refs: DataFrame) -> DataFrame:
        """Answers of pairs with a common leader from their differences to it: a, b and how many shingles they differ in."""
        for side in ("a", "b"):
            pairs = pairs.join(refs.select(F.col("id").alias(side), F.col("delta").alias(f"delta_{side}"), F.col("size").alias(f"size_{side}")).hint("merge"), side)
        return pairs.select("a", "b", "size_a", "size_b", (F.size("delta_a") + F.size("delta_b") - 2 * F.size(F.array_intersect("delta_a", "delta_b"))).cast("long").alias("differ"))

    def join_links(self, extra: DataFrame | None = None) -> None:
        """Components by all links found so far and the edges ``extra``."""
        linked = [c.filter(self.linked("size_a + size_b - 2 * common", "size_a + size_b")).filter("a <> b") for c in self.compared]
        # of a node linked with both its leaders one link is kept, and the leaders are joined: few nodes have two links then
        first = linked[0].groupBy("a").agg(F.min("b").alias("b"), F.max("b").alias("z"))
        found = [first.select("a", "b"), first.filter("b <> z").select(F.col("b").alias("a"), F.col("z").alias("b")).distinct()]
        found += [c.select("a", "b") for c in linked[1:]]
        found += [d.filter(self.linked("differ", "size_a + size_b")).select("a", "b") for d in self.derived] + ([extra] if extra is not None else [])
        every = found[0]
        for more in found[1:]:
            every = every.unionByName(more)
        if self.roots is not None:
            free(self.roots)
        self.roots = components(every)

    def run(self, extra: DataFrame) -> DataFrame:
        """Roots of the components: (node, root) of all nodes but the roots. ``extra`` are edges known beforehand."""
        keep = Fraction(min(1, 2 * (1 - self.t))) / (1 + self.t)  # differences twice as far as a link's are kept
        pairs = self.leader_pairs()
        self.compared.append(differences(self.docs, pairs, self.n, keep))
        free(pairs)
        self.join_links(extra)
        hubs = self.hub_pairs()
        # differences of any size: a node without one would meet all its hub's followers in their lists
        self.compared.append(differences(self.docs, hubs, self.n, Fraction(1)))
        refs = cut(self.reference(self.compared[1]), "references")
        pairs = self.plausible(refs).unionByName(self.close_differences(refs))
        free(hubs)
        if pairs.count() > self.nodes.count():
            self.compare(pairs.groupBy("ra", "rb").agg(F.min(F.struct("slack", "a", "b", "ref")).alias("p")).select("p.a", "p.b", "p.ref"), refs)
            self.join_links(extra)
            for side in ("a", "b"):
                roots = self.roots.select(F.col("node").alias(side), F.col("root").alias(f"top_{side}"))
                pairs = pairs.join(roots.hint("merge"), side, "left").withColumn(f"top_{side}", F.coalesce(f"top_{side}", side))
            pairs = pairs.filter("top_a <> top_b").join(self.seen().hint("merge"), ["a", "b"], "left_anti")
        if not pairs.isEmpty():
            self.compare(pairs.select("a", "b", "ref"), refs)
            self.join_links(extra)
        free(refs, *self.compared, *self.derived)
        return self.roots

    def compare(self, pairs: DataFrame, refs: DataFrame) -> None:
        """Answers of the pairs (a, b, ref): from the common leader where there is one, else from the sets."""
        pairs = cut(pairs, "next")
        self.derived.append(cut(self.derive(pairs.filter("ref IS NOT NULL").select("a", "b"), refs), "derived"))
        rest = pairs.filter("ref IS NULL").select("a", "b")
        if not rest.isEmpty():
            self.compared.append(differences(self.docs, rest, self.n, Fraction(0)))
        free(pairs)


def _differ(a: str, b: str) -> str:
    """Bits that two bitmaps differ in; one of twice the width is folded first."""
    same = f"aggregate(zip_with({a}, {b}, (p, q) -> bit_count(p ^ q)), 0, (s, c) -> s + c)"
    folded = lambda x, m: f"CASE WHEN size({x}) > {m} THEN zip_with(slice({x}, 1, {m}), slice({x}, {m} + 1, {m}), (p, q) -> p ^ q) ELSE {x} END"
    m = f"least(size({a}), size({b}))"
    apart = f"aggregate(zip_with({folded(a, m)}, {folded(b, m)}, (p, q) -> bit_count(p ^ q)), 0, (s, c) -> s + c)"
    return f"CASE WHEN size({a}) = size({b}) THEN {same} ELSE {apart} END"


def link_components(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles and component_id, the smallest id reachable by links."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    named = rows.filter("id IS NOT NULL")
    heads = cut(prefixes(rows, n, threshold, None if threshold >= PARTS_FROM else frequency_classes(named, n)), "prefixes")
    found = heads.withColumn("key", F.struct("k1", "k2", "size"))
    filled = found.filter("size > 0 AND id IS NOT NULL")
    sets = filled.groupBy("key").agg(F.min("id").alias("node"))
    own = cut(filled.join(sets.withColumnRenamed("node", "id").hint("merge"), ["key", "id"], "left_semi").dropDuplicates(["key", "id"]).select("id", "size", "sc", "prefix", "below", "bits", *SHORT_BITS), "nodes")
    members = cut(lookup(found.select("id", "size", F.when(F.col("id").isNotNull(), F.col("key")).alias("key")), "key", sets, F.col("id")).select("id", "size", "node"), "members")
    free(heads)
    postings = own.select("id", "size", "sc", F.size("prefix").alias("head"), F.posexplode(F.concat("prefix", "below")).alias("at", "token"))
    postings = postings.select("id", "size", "sc", F.expr("IF(at < head, at, at - head)").alias("pos"), "token")
    shared = cut(postings.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1"), "tokens")
    total = own.agg(F.sum(F.size("prefix") + F.size("below"))).first()[0] or 0
    most = max(HOT_ROWS, total // HOT_SHARE)
    salts = F.ceil(F.col("n") / F.lit(most)).cast("int")
    hot = shared.filter(F.col("n") > most).select("token", salts.alias("salts"))
    lists = postings.join(F.broadcast(hot), "token", "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    lists = cut(lists.join(shared.select("token", "n", salts.alias("salts"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")).hint("merge"), ["token", "salt"]), "lists")
    # ids that several texts bear
    several = members.filter("node IS NOT NULL").groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").select("id", "a")
    twins = members.join(several.hint("merge"), "id").select("a", F.col("node").alias("b")).distinct()
    roots = _Join(named, own.select("id", "size", "bits", *SHORT_BITS), lists, n, threshold).run(twins)
    free(own, shared, lists)
    out = lookup(members, "node", roots, F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.coalesce("root", "node", "id").alias("component_id"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: components of 3-word shingle sets by Jaccard of at least 0.9."""
    return link_components(table(spark, sf_dir, "documents"), 3, Fraction(9, 10))
