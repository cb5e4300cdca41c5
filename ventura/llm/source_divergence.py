"""Source divergence audit: how far the term use of each source of a language is from every other's, from joint count histograms.

Terms are counted per (lang, source) in one pass: tasks count their rows' terms in bounded tables and Spark adds them up. For a
pair of sources, the distance is a sum over all kept terms of a function f of the two counts alone; so what is tallied per
pair is the joint histogram, the number of terms for each distinct (count, count), with zeros implied: terms that only one
of the two has come from that source's own histogram less the joint cells, and terms that neither has from what is left of
the vocabulary. f is then evaluated once per distinct combination and multiplied by the number of its terms.

Sources of a language are dealt to blocks of BLOCK. Each count goes to the pairs of blocks that hold its source; a group of
(pair of blocks, term) thus has at most 2 * BLOCK rows whatever the number of sources, and a task tallies its cells before
they are shuffled. With at most BLOCK sources nothing is copied. The result itself has a row per ordered pair of sources.

All arithmetic is exact: p = 1 + floor(10^9 (count + 2) / (N + 2 V)) by decimal division, f = floor((p - q)^2 / (p + q)) in
64-bit integers. Null text, lang and source count as ''. Rows are documents even if they or their ids repeat. A group without
terms still has its pairs; a language without kept terms has pair values of 0. An empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ventura.llm.common import cut, lookup, table
from ventura.session import ship

#: A term is kept in a language if so many of its documents have it; ranks listed per group in part ``term``.
LEAST_DOCS, TOP = 10, 10
#: Sources of a block, entries of a task's table of terms, cells of a task's tally.
BLOCK, TABLE_ROWS, TALLY_ROWS = 64, 200_000, 1_000_000
SCALE = 1_000_000_000
#: [^\x00-\x40\x5B-\x60\x7B-\x7F]+ over the UTF-8 bytes of a text whose A-Z are lower-cased: all bytes above 7F belong to a term.
_TERM = re.compile(rb"[a-z\x80-\xff]+")


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Per (lang, source, term): n occurrences, n_docs documents. Whole texts, one pass."""
    ship(docs.sparkSession)
    most = TABLE_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter[bytes], Counter[bytes]]] = {}

        def drain() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, n_docs) in counts.items():
                terms = list(n)
                columns = [[lang] * len(terms), [source] * len(terms), terms, list(n.values()), [n_docs[t] for t in terms]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()))], ["lang", "source", "term", "n", "n_docs"])
            counts.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                n, n_docs = counts.setdefault((lang, source), (Counter(), Counter()))
                terms = _TERM.findall(text.lower())  # bytes: A-Z alone
                n.update(terms)
                n_docs.update(set(terms))
            if sum(len(n) for n, _ in counts.values()) > most:
                yield from drain()
        yield from drain()

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), empty(text_col).cast("binary").alias("text"))
    made = rows.mapInArrow(run, "lang string, source string, term binary, n long, n_docs long")
    return made.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def _share(count: str, total: str, vocabulary: str) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * vocabulary)), exactly."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10, 0)) * cast({count} + 2 as decimal(20, 0))) div cast({total} + 2 * {vocabulary} as decimal(20, 0))")


def _f(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _cells(batch: pa.RecordBatch, block: int) -> pd.DataFrame:
    """A row for each pair of entries of one term, by lists of equal length at once."""
    entries = batch.column("entries")
    flat = entries.flatten()
    g, n, p, p0 = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("g", "n", "p", "p0"))
    starts = np.asarray(entries.offsets)[:-1] - entries.offsets[0].as_py()
    sizes, apart = np.asarray(entries.value_lengths()), np.asarray(batch.column("a")) != np.asarray(batch.column("b"))
    lang, left, right, row = batch.column("lang").to_pandas(), [], [], []
    for k in np.unique(sizes):
        rows = np.flatnonzero(sizes == k)
        at = starts[rows][:, None] + np.arange(k)
        at = np.take_along_axis(at, np.argsort(g[at], axis=1), axis=1)
        i, j = np.triu_indices(k, 1)
        left.append(at[:, i].ravel())
        right.append(at[:, j].ravel())
        row.append(np.repeat(rows, len(i)))
    left, right, row = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right, row))
    wanted = ~apart[row] | (g[left] // block != g[right] // block)  # pairs within a block are met where the block meets itself
    left, right, row = left[wanted], right[wanted], row[wanted]
    return pd.DataFrame({"lang": lang.to_numpy()[row], "g": g[left], "h": g[right], "c": n[left], "d": n[right], "p": p[left], "q": p[right], "p0": p0[left], "q0": p0[right], "m": 1})


def _tally(block: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Joint cells, added up per task in tables of about ``most`` rows."""
    keys, shares = ["lang", "g", "h", "c", "d"], ["p", "q", "p0", "q0"]  # a count's share follows from its group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        added_up = lambda: pd.concat(parts, ignore_index=True).groupby(keys, sort=False, as_index=False).agg({k: "first" for k in shares} | {"m": "sum"})
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                parts.append(_cells(batch.slice(k, 500), block))
                size += len(parts[-1])
                if size > most:
                    parts = [added_up()]
                    if len(parts[0]) * 2 > most:
                        yield pa.RecordBatch.from_pandas(parts.pop(), preserve_index=False)
                    size = sum(map(len, parts))
        if parts:
            yield pa.RecordBatch.from_pandas(added_up(), preserve_index=False)

    return run


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """Per group: lang, source, part (pair or term), item, value, rank."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    by_term = Window.partitionBy("lang", "term")
    counts = term_counts(docs, lang_col, source_col, text_col)
    counts = counts.select("lang", "source", "term", "n", F.sum("n_docs").over(by_term).alias("lang_docs"), F.sum("n").over(by_term).alias("lang_n"), F.row_number().over(by_term.orderBy("source")).alias("nth"))
    kept = cut(counts.filter(F.col("lang_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n", "nth"), "terms")

    in_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.when(F.col("nth") == 1, 1)).alias("v"))
    in_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    sizes = docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source")).distinct().join(in_group, ["lang", "source"], "left").join(in_lang, "lang", "left").fillna(0, ["total", "own", "lang_total", "v"])
    number = Window.partitionBy("lang").orderBy("source")
    sizes = sizes.withColumns({"g": (F.row_number().over(number) - 1).cast("long"), "n_sources": F.count("*").over(Window.partitionBy("lang")), "p0": F.when(F.col("v") > 0, _share("0L", "total", "v"))})
    sizes = cut(sizes.withColumn("group", F.struct("lang", "source")), "groups")

    # a group may hold a third of all rows, so its totals are handed out by slices
    rows = lookup(kept.withColumn("group", F.struct("lang", "source")), "group", sizes.select("group", "g", "n_sources", "total", "lang_total", "v", "p0"), F.col("term"))
    rows = cut(rows.withColumns({"p": _share("n", "total", "v"), "lang_p": _share("lang_n", "lang_total", "v")}).drop("group", "nth"), "shares")

    blocks = F.expr(f"sequence(0L, (n_sources - 1) div {BLOCK})")
    dealt = rows.withColumn("block", F.expr(f"g div {BLOCK}")).withColumn("other", F.explode(blocks))
    grouped = dealt.groupBy("lang", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "term").agg(F.collect_list(F.struct("g", "n", "p", "p0")).alias("entries"))
    cells = grouped.select("lang", "a", "b", "entries").mapInArrow(_tally(BLOCK, TALLY_ROWS), "lang string, g long, h long, c long, d long, p long, q long, p0 long, q0 long, m long")

    half = sizes.select("lang", F.col("g"), F.col("p0"), F.col("own"), "v")
    pairs = half.join(half.select("lang", F.col("g").alias("h"), F.col("p0").alias("q0"), F.col("own").alias("other_own")), "lang").filter("g < h")
    alone = rows.groupBy("lang", "g", "n", "p").agg(F.count("*").alias("m"))
    first = pairs.select("lang", "g", "h", "q0").join(alone, ["lang", "g"]).selectExpr("lang", "g", "h", "n c", "0L d", "p", "q0 q", "m")
    second = pairs.select("lang", "g", "h", "p0").join(alone.selectExpr("lang", "g h", "n", "p q", "m"), ["lang", "h"]).selectExpr("lang", "g", "h", "0L c", "n d", "p0 p", "q", "m")
    neither = pairs.filter("v > 0").selectExpr("lang", "g", "h", "0L c", "0L d", "p0 p", "q0 q", "v - own - other_own m")
    both = cells.selectExpr("lang", "g", "h", "stack(4, c, d, p, q, m, c, 0L, p, q0, -m, 0L, d, p0, q, -m, 0L, 0L, p0, q0, m) as (c, d, p, q, m)")
    histogram = both.unionByName(first).unionByName(second).unionByName(neither).groupBy("lang", "g", "h", "c", "d", "p", "q").agg(F.sum("m").alias("m"))
    value = histogram.select("lang", "g", "h", (_f("p", "q") * F.col("m")).alias("value")).groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))

    whole = pairs.select("lang", "g", "h").join(value, ["lang", "g", "h"], "left").fillna(0, ["value"])
    ordered = whole.selectExpr("lang", "value", "stack(2, g, h, h, g) as (g, h)")
    named = ordered.join(sizes.select("lang", "g", "source"), ["lang", "g"]).join(sizes.select("lang", F.col("g").alias("h"), F.col("source").alias("item")), ["lang", "h"])
    part_pair = named.selectExpr("lang", "source", "'pair' part", "item", "value")
    part_term = rows.filter(F.col("p") > F.col("lang_p")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f("p", "lang_p").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = part_term.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return part_pair.withColumn("rank", F.row_number().over(order)).unionByName(ranked)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return audit(table(spark, sf_dir, "documents"))


ORACLE = r"""
with d as (select row_number() over () rid, coalesce(lang, '') lang, coalesce(source, '') source, coalesce(text, '') t from documents),
u as (select rid, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from d),
c as (select lang, source, term, count(*) n, count(distinct rid) n_docs from u group by all),
l as (select lang, term, sum(n) n from c group by all having sum(n_docs) >= 10),
lt as (select lang, sum(n)::hugeint total, count(*)::hugeint v from l group by all),
g as (select distinct lang, source from d),
k as (select c.lang, c.source, c.term, c.n from c join l using (lang, term)),
gt as (select g.lang, g.source, coalesce(sum(k.n), 0)::hugeint total from g left join k on g.lang = k.lang and g.source = k.source group by all),
s as (select gt.lang, gt.source, l.term, coalesce(k.n, 0) n, 1 + (1000000000::hugeint * (coalesce(k.n, 0) + 2)) // (gt.total + 2 * lt.v) p,
  1 + (1000000000::hugeint * (l.n + 2)) // (lt.total + 2 * lt.v) q
  from gt join l on gt.lang = l.lang join lt on lt.lang = gt.lang left join k on k.lang = gt.lang and k.source = gt.source and k.term = l.term),
pv as (select a.lang, a.source, b.source item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) value from s a join s b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' part, b.source item, coalesce(pv.value, 0)::bigint value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join pv on pv.lang = a.lang and pv.source = a.source and pv.item = b.source),
terms as (select lang, source, 'term' part, term item, (((p - q) * (p - q)) // (p + q))::bigint value from s where n > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int rank from (select * from pairs union all select * from terms))
select lang, source, part, item, value, rank from r where part = 'pair' or rank <= 10
"""
