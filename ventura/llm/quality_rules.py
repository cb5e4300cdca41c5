"""Quality rules: learned decision lists over text statistics, emitted as ordered Spark conditional expressions.

``statistics`` measures a text with DataFrame functions alone. ``learn`` runs sequential covering over the statistics of
labelled rows: a rule, a conjunction of thresholds, is grown by information gain on two thirds of the rows and pruned to
its shortest beginning that is precise enough on these and on the other third; its thresholds are moved halfway towards
the bulk of the rows it hits; covered rows leave and the next rule is grown until none is precise enough. ``verdict`` turns the list into one
``when(...).when(...).otherwise(...)`` column.

The model is fitted on at most SAMPLE_ROWS labelled rows, those of the smallest hash of the id; that is the only bound,
and every text is measured whole. Null text has no words and fails the base rule; empty tables give empty results (with
no labelled rows the list is empty and the base rule alone decides); ids may repeat; further columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ventura.llm.common import BLANKS, table

SAMPLE_ROWS = 20_000
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Shares the learner may set thresholds on.
FEATURES = ("n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "bar_share", "line_words")


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def statistics(docs: DataFrame, id_col: str | Column = "doc_id", text_col: str = "text") -> DataFrame:
    """id (a column or the name of one) and the counts and shares of FEATURES for each row's whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select((F.col(id_col) if isinstance(id_col, str) else id_col).alias("id"), text.alias("t")).select(
        "id",
        "t",
        F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"),
        F.filter(F.split("t", "\n"), lambda x: F.translate(x, BLANKS, "") != "").alias("lines"),
    )
    size = F.length("t")
    rows = rows.select(
        "id",
        F.transform("words", lambda w: F.xxhash64(w)).alias("w"),
        _without(F.col("t"), BLANKS).cast("long").alias("word_chars"),
        (size - _without(F.col("t"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        (size - _without(F.col("t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("upper"),
        (size - _without(F.col("t"), "0123456789")).alias("digits"),
        (size - _without(F.col("t"), "!?")).alias("marks"),
        (size - _without(F.col("t"), "|")).alias("bars"),
    )
    # Hashes of the 5-word windows; a text without two equal ones, the common case, is done with one distinct count.
    window = F.transform("w", lambda h, i: F.xxhash64(h, *(F.get("w", i + k) for k in range(1, WINDOW))))
    rows = rows.withColumn("n_words", F.size("w").cast("long")).withColumn("windows", F.slice(window, 1, F.greatest(F.size("w") - (WINDOW - 1), F.lit(0))))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("sorted", F.when(repeats, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))

    def twice(p: Column, j: Column) -> Column:
        return F.coalesce(F.get("sorted", j - 1)["h"] == p["h"], F.lit(False)) | F.coalesce(F.get("sorted", j + 1)["h"] == p["h"], F.lit(False))

    rows = rows.withColumn("places", F.sort_array(F.transform(F.filter("sorted", twice), lambda p: p["i"])))
    covered = F.aggregate(F.transform("places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("places", k + 1) - p, F.lit(WINDOW))).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    # A filter on a deterministic column is pushed below the projections and computes each array many times over, for each
    # element; the (always true) test of the row number keeps it above them.
    rows = rows.withColumn("n_repeat_words", F.when(F.monotonically_increasing_id() >= 0, F.coalesce(covered, F.lit(0).cast("long"))))
    chars, words, lines = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("word_chars", "n_words", "n_lines"))
    return rows.select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("word_chars") / words).alias("word_length"),
        (F.col("n_symbols") / chars).alias("symbol_share"),
        (F.col("n_dup_lines") / lines).alias("dup_line_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"),
        (F.col("upper") / chars).alias("upper_share"),
        (F.col("digits") / chars).alias("digit_share"),
        (F.col("marks") / chars).alias("mark_share"),
        (F.col("bars") / words).alias("bar_share"),
        (F.col("n_words") / lines).alias("line_words"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    value: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.value if self.above else row[self.feature] <= self.value

    def column(self) -> Column:
        return F.col(self.feature) > self.value if self.above else F.col(self.feature) <= self.value

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.value:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, rows: list[dict]) -> list[dict]:
    return [r for r in rows if all(c.holds(r) for c in rule)]


def _counts(rows: list[dict]) -> tuple[int, int]:
    bad = sum(r["bad"] for r in rows)
    return bad, len(rows) - bad


def _grow(rows: list[dict], thresholds: dict[str, list[float]], most: int) -> Rule:
    """A conjunction that gains most, condition by condition, until it covers bad rows alone."""
    rule: Rule = ()
    while len(rule) < most:
        bad, good = _counts(rows)
        if not bad or not good:
            break
        base, best = math.log2(bad / (bad + good)), (1e-9, None)
        for feature, values in thresholds.items():
            # counts of the rows between thresholds, then running sums, give every split of a feature in one scan
            order = sorted((r[feature], r["bad"]) for r in rows)
            at, p, n = 0, 0, 0
            for v in values:
                while at < len(order) and order[at][0] <= v:
                    p, n, at = p + order[at][1], n + 1 - order[at][1], at + 1
                for above, (a, b) in ((False, (p, n)), (True, (bad - p, good - n))):
                    if a and (gain := a * (math.log2(a / (a + b)) - base)) > best[0]:
                        best = (gain, Condition(feature, above, v))
        if best[1] is None:
            break
        rule += (best[1],)
        rows = _covers(rule, rows)
    return rule


def _widened(rule: Rule, rows: list[dict]) -> Rule:
    """Each threshold moved halfway to the bulk of the bad rows it lets pass, so that rows just beyond it are not hit."""
    bad = [r for r in _covers(rule, rows) if r["bad"]]
    out = []
    for c in rule:
        own = sorted((r[c.feature] for r in bad), reverse=not c.above)
        bulk = own[len(own) // 50]
        out.append(Condition(c.feature, c.above, (c.value + bulk) / 2))
    return tuple(out)


def learn(rows: list[dict], max_rules: int = 12, max_conditions: int = 3, least_precision: float = 0.9, least_share: float = 0.004, cut_points: int = 48) -> list[Rule]:
    """An ordered list of rules for bad rows. ``rows`` have the FEATURES, ``bad`` (0/1) and ``part`` (0..2; 2 prunes)."""
    grow, prune = [r for r in rows if r["part"] < 2], [r for r in rows if r["part"] == 2]
    if not grow or not prune:
        return []
    thresholds = {}
    for f in FEATURES:
        values = sorted(r[f] for r in grow)
        own = sorted({values[min(len(values) - 1, k * len(values) // cut_points)] for k in range(cut_points)} | {values[-max(1, len(values) // k)] for k in (100, 200, 400)})
        thresholds[f] = own
    found: list[Rule] = []
    total = len(grow)
    while len(found) < max_rules:
        rule = _grow(grow, thresholds, max_conditions)
        if not rule:
            break

        def precise(r: Rule, part: list[dict], least: float) -> bool:
            p, n = _counts(_covers(r, part))
            return p >= max(1.0, least) and p >= least_precision * (p + n)

        short = (rule[: k + 1] for k in range(len(rule)))
        rule = next((r for r in short if precise(r, grow, least_share * total) and precise(r, prune, 1)), None)
        if rule is None:
            break
        rule = _widened(rule, grow)
        found.append(rule)
        covered = {id(r) for r in _covers(rule, grow)}
        grow = [r for r in grow if id(r) not in covered]
        covered = {id(r) for r in _covers(rule, prune)}
        prune = [r for r in prune if id(r) not in covered]
    return found


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that holds (from 1), or null: an ordered conditional expression."""
    out = None
    for k, rule in enumerate(rules, 1):
        test = rule[0].column()
        for c in rule[1:]:
            test &= c.column()
        out = F.when(test, F.lit(k)) if out is None else out.when(test, F.lit(k))
    return F.lit(None).cast("int") if out is None else out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: Column, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Statistics of at most ``sample_rows`` labelled rows; the ids are bounded by that, so they are broadcast."""
    picked = labels.select(F.col("doc_id").alias("id"), label.cast("int").alias("bad")).dropna().dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")
    made = statistics(rows, "id", "text").join(F.broadcast(picked), "id")
    made = made.select("bad", F.pmod(F.xxhash64("id", F.lit("part")), F.lit(3)).alias("part"), F.xxhash64("id").alias("order"), *FEATURES)
    return sorted((r.asDict() for r in made.collect()), key=lambda r: r["order"])


def _judged(docs: DataFrame, rules: list[Rule], id_col: str | Column, text_col: str) -> DataFrame:
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    made = statistics(docs, id_col, text_col).withColumn("base_failed", failed).withColumn("rule", verdict(rules))
    return made.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, the counts, base_failed, rule (number of the learned rule that rejects it) and kept."""
    made = _judged(docs, rules, id_col, text_col)
    return made.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept")


def keep_good(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns: the row travels as a struct beside its statistics."""
    return _judged(docs, rules, F.struct("*"), text_col).filter("kept").select("id.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, judged by the base rule and the list learned from labels.quality (0 is bad)."""
    docs = table(spark, sf_dir, "documents")
    rules = learn(labelled_sample(docs, table(spark, sf_dir, "labels"), 1 - F.col("quality")))
    return judge(docs, rules)
