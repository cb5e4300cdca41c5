"""Line dedup: content-defined chunks of lines; repeated ones are removed after byte comparison.

A rolling (cyclic polynomial) hash runs over the hashes of a document's lines. A chunk ends after a line where a bit of
it is 0, so boundaries depend on WINDOW lines alone and come back after any shift. These find short repeats: chunks
under LONG_WORDS words of two lines or more that have words count; a chunk of one line counts together with the chunk
after it. Longer repeats don't depend on boundaries: from every line with words the shortest run of lines forward that
reaches LONG_WORDS words is a chunk, and so is the shortest one backward. Whatever its neighbours are, a passage of that
many words is covered to its last line, by the runs from its first lines and the run back from its last; a line of
LONG_WORDS words is a run by itself. Of equal chunks anywhere in the table, in one document or in many, the first by
(id, position) stays and the others go.

Only chunk hashes are grouped, combined before the shuffle. Chunks that repeat and overlap or touch are joined into
ranges where the first ones lie in one document at one distance, so that text is fetched once per range and not per
chunk. Every chunk of a range is compared with the first by its lines' bytes, dealt out by (hash, length, salt) with a
copy of the first for every SALT_ROWS ranges, so a passage in a third of all documents is spread over many tasks.
Everything is DataFrame functions.

Defined cases: null text stays null and empty text empty; rows equal in id and text are treated alike; null ids sort
first; an empty table gives an empty result; further columns are passed through whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ventura.llm.common import cut, table

WINDOW, LONG_WORDS, SALT_ROWS = 2, 50, 256


def _rotate(h: Column, by: int) -> Column:
    return F.shiftleft(h, by).bitwiseOR(F.shiftrightunsigned(h, 64 - by))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The row as a struct, so that no name clashes, with its key (id and hash of the text)."""
    return docs.select(F.struct("*").alias("row")).select("row", F.col(f"row.{id_col}").alias("id"), F.xxhash64(f"row.{text_col}").alias("th"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def chunks(keyed: DataFrame) -> DataFrame:
    """One row per chunk that may be removed: id, th, start (from 0), n (lines), h."""
    rows = keyed.select("id", "th", "lines", F.transform("lines", lambda x: F.xxhash64(x)).alias("lh"), F.transform("lines", lambda x: F.size(F.filter(F.split(x, r"[\x20\x09-\x0D]+"), lambda w: w != ""))).alias("words"))

    def rolling(h: Column, i: Column) -> Column:
        for k in range(1, WINDOW):
            h = h.bitwiseXOR(_rotate(F.coalesce(F.get("lh", i - k), F.lit(0).cast("long")), k))
        return h

    rows = rows.withColumn("roll", F.transform("lh", rolling))
    last = F.size("lines") - 1
    long = lambda i: F.coalesce(F.get("words", i) >= LONG_WORDS, F.lit(False))
    cuts = F.transform("roll", lambda h, i: F.when((F.xxhash64(h).bitwiseAND(F.lit(1).cast("long")) == 0) | long(i) | long(i + 1) | (i == last), i))
    rows = rows.withColumn("ends", F.filter(cuts, lambda e: e.isNotNull()))
    made = F.transform("ends", lambda e, j: F.struct(F.coalesce(F.get("ends", j - 1) + 1, F.lit(0)).alias("start"), e.alias("end")))
    rows = rows.withColumn("made", made)

    def with_next(c: Column, j: Column) -> Column:
        """A chunk of one line and the chunk after it, neither being a long line."""
        after = F.get("made", j + 1)
        return F.when((c["start"] == c["end"]) & ~long(c["start"]) & after.isNotNull() & ~long(after["start"]), F.struct(c["start"].alias("start"), after["end"].alias("end")))

    rows = rows.withColumn("made", F.concat("made", F.array_compact(F.transform("made", with_next))))
    inside = lambda c: F.slice("words", c["start"] + 1, c["end"] - c["start"] + 1)
    short = lambda c: (F.size(F.filter(inside(c), lambda n: n > 0)) > 1) & (F.aggregate(inside(c), F.lit(0), lambda a, n: a + n) < LONG_WORDS)
    packed = lambda start, end: F.shiftleft(start.cast("long"), 32) + end
    small = F.transform(F.filter("made", short), lambda c: packed(c["start"], c["end"]))
    # runs over the lines with words alone, LONG_WORDS of which always suffice
    rows = rows.withColumn("at", F.filter(F.sequence(F.lit(0), last), lambda i: F.get("words", i) > 0)).withColumn("has", F.filter("words", lambda n: n > 0))

    def reached(counts: Column) -> Column:
        """How many of the counts make LONG_WORDS, null if all are too few."""
        step = lambda a, n: F.when(a["sum"] < LONG_WORDS, F.struct((a["sum"] + n).alias("sum"), (a["k"] + 1).alias("k"))).otherwise(a)
        return F.aggregate(counts, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("k")), step, lambda a: F.when(a["sum"] >= LONG_WORDS, a["k"]))

    forward = lambda at, i: packed(at, F.get("at", i + reached(F.slice("has", i + 1, LONG_WORDS)) - 1))
    before = lambda i: F.reverse(F.slice("has", F.greatest(i - LONG_WORDS + 2, F.lit(1)), F.least(i + 1, F.lit(LONG_WORDS))))
    backward = lambda at, i: packed(F.get("at", i - reached(before(i)) + 1), at)
    rows = rows.withColumn("made", F.array_distinct(F.array_compact(F.concat(small, F.transform("at", forward), F.transform("at", backward)))))
    start, end = (lambda c: F.shiftright(c, 32).cast("int")), (lambda c: c.bitwiseAND(F.lit(2**31 - 1).cast("long")).cast("int"))
    out = F.transform("made", lambda c: F.struct(start(c).alias("start"), (end(c) - start(c) + 1).alias("n"), F.xxhash64(F.slice("lh", start(c) + 1, end(c) - start(c) + 1)).alias("h")))
    return rows.select("id", "th", F.explode(out).alias("c")).select("id", "th", "c.start", "c.n", "c.h")


def ranges(places: DataFrame) -> DataFrame:
    """Chunks that aren't the first of their hash, joined where they overlap or touch at one distance from their firsts:
    id, th, start, n, parts (start in the range and n of each chunk), h of the chunk at the start, and its first."""
    places = places.select("id", "th", "start", "n", "h", F.col("first.id").alias("fid"), F.col("first.th").alias("fth"), (F.col("start") - F.col("first.start")).alias("far"))
    one = ["id", "th", "fid", "fth", "far"]
    ordered = Window.partitionBy(*one).orderBy("start", "n", "h")
    reach = F.max(F.col("start") + F.col("n")).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    rows = places.distinct().withColumn("fresh", F.when(F.col("start") > reach, 1).otherwise(0))
    rows = rows.withColumn("number", F.sum("fresh").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    # the shortest chunk at the start names the range: with the length, it tells the first's lines wherever they occur
    made = rows.groupBy(*one, "number").agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("n")) - F.min("start")).alias("n"), F.min_by("h", F.struct("start", "n", "h")).alias("h"), F.collect_list(F.struct("start", "n")).alias("parts"))
    parts = F.transform("parts", lambda p: F.struct((p["start"] - F.col("start")).alias("start"), p["n"].alias("n")))
    return made.select("id", "th", "start", "n", "h", parts.alias("parts"), F.struct(F.col("fid").alias("id"), F.col("fth").alias("th"), (F.col("start") - F.col("far")).alias("start")).alias("first"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", report: bool = False) -> DataFrame:
    """``docs`` with its columns and the repeated chunks gone from the text; ``report`` adds n_lines, removed_lines, removed_chunks."""
    keyed = _keyed(docs, id_col, text_col)
    text = F.col(f"row.{text_col}")
    found = cut(chunks(keyed.select("id", "th", _lines(text).alias("lines"))), "chunks")
    repeated = found.groupBy("h").agg(F.count("*").alias("copies"), F.min(F.struct("id", "th", "start")).alias("first")).filter("copies > 1")
    places = found.join(repeated, "h")
    is_first = F.struct("id", "th", "start").eqNullSafe(F.col("first"))
    found = cut(ranges(places.filter(~is_first)), "ranges")
    counted = found.groupBy("h", "n").agg(F.count("*").alias("copies"), F.min("first").alias("first"))
    others = found.join(counted.select("h", "n", "copies"), ["h", "n"]).select("id", "th", "start", "n", "h", "copies", "parts", F.lit(False).alias("is_first"))
    firsts = counted.select("first.*", "n", "h", "copies", F.lit(None).cast(found.schema["parts"].dataType).alias("parts"), F.lit(True).alias("is_first"))
    wanted = others.unionByName(firsts).groupBy("id", "th").agg(F.collect_list(F.struct("start", "n", "h", "copies", "parts", "is_first")).alias("places"))
    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["th"] == b["th"])
    # Lines are split after the joins, so the text alone is dealt out.
    texts = keyed.select("id", "th", text.alias("text")).alias("d").join(wanted.alias("w"), same(_Side("d"), _Side("w"))).select("d.id", "d.th", _lines(F.col("d.text")).alias("lines"), F.explode("w.places").alias("p"))
    texts = texts.select("id", "th", "p.*", F.slice("lines", F.col("p.start") + 1, F.col("p.n")).alias("own"))
    texts = cut(texts, "repeated")
    salts = F.ceil(F.col("copies") / SALT_ROWS).cast("int")
    first = texts.filter("is_first").select("h", "n", "copies", F.col("own").alias("kept")).dropDuplicates(["h", "n"]).select("h", "n", "kept", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    others = texts.filter("NOT is_first").withColumn("salt", F.pmod(F.xxhash64("id", "th", "start"), salts).cast("int"))
    part = lambda c, p: F.slice(c, p["start"] + 1, p["n"])
    equal = F.when(F.col("own") == F.col("kept"), F.col("parts")).otherwise(F.filter("parts", lambda p: part("own", p) == part("kept", p)))
    gone = others.join(first, ["h", "n", "salt"]).select("id", "th", F.col("start").alias("base"), F.explode(equal).alias("p")).select("id", "th", (F.col("base") + F.col("p.start")).alias("start"), "p.n").distinct()
    gone = gone.groupBy("id", "th").agg(F.collect_list(F.struct("start", "n")).alias("gone"))
    out = keyed.alias("d").join(gone.alias("g"), same(_Side("d"), _Side("g")), "left").select("d.row", _lines(F.col(f"d.row.{text_col}")).alias("lines"), F.col("g.gone").alias("gone"))
    dropped = F.flatten(F.transform("gone", lambda g: F.sequence(g["start"], g["start"] + g["n"] - 1)))
    out = out.withColumn("dropped", F.array_distinct(dropped))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped")), lambda i: F.get("lines", i))
    cleaned = F.when(F.col("dropped").isNull(), text).otherwise(F.array_join(kept, "\n"))
    names = [cleaned.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    if report:
        names += [F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("removed_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("removed_chunks")]
    return out.select(*names)


class _Side:
    """Columns of one side of a join by its alias."""

    def __init__(self, alias: str):
        self.alias = alias

    def __getitem__(self, name: str) -> Column:
        return F.col(f"{self.alias}.{name}")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, the text without repeated chunks, and what was removed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, report=True)
