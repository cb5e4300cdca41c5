"""Bootstraps on Spark: a row expands into runs of draws, each with a generator of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ventura.functions.stats import precision_recall

#: Draws of a run; runs, not draws, are the rows that Spark deals out.
RUN = 1000


def _draws(rows: DataFrame, key: str, draws: int, seed: int, inputs: list[str], output: str, draw: Callable[[np.random.Generator, int, tuple], dict]) -> DataFrame:
    """Rows (key, draw, ``output``) of each row's draws. A run's generator is seeded by the row's key and the run's number."""

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                size = min(RUN, draws - r.run * RUN)
                made = draw(np.random.default_rng([seed, r.h & 0x7FFFFFFF, r.run]), size, tuple(getattr(r, c) for c in inputs))
                yield pd.DataFrame({"key": r.key, "draw": r.run * RUN + np.arange(size), **made})

    runs = F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // RUN))).alias("run")
    given = rows.select(F.col(key).cast("string").alias("key"), F.crc32(F.col(key).cast("string").cast("binary")).alias("h"), runs, *inputs)
    return given.mapInPandas(sample, f"key string, draw int, {output}").withColumnRenamed("key", key)


def beta_bootstrap(counts: DataFrame, key: str, hits: str, n: str, draws: int = 20_000, seed: int = 11) -> DataFrame:
    """2.5, 50 and 97.5 percentiles of each row's share under its Jeffreys posterior."""
    made = _draws(counts, key, draws, seed, [hits, n], "share double", lambda rng, size, r: {"share": rng.beta(r[0] + 0.5, r[1] - r[0] + 0.5, size)})
    p = made.groupBy(key).agg(F.percentile("share", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("p"))
    return p.select(key, F.col("p")[0].alias("lo"), F.col("p")[1].alias("mid"), F.col("p")[2].alias("hi"))


def corrected_draws(counts: DataFrame, key: str, draws: int = 20_000, seed: int = 8) -> DataFrame:
    """Draws of each row's prevalence corrected for its own test error: (key, draw, share).

    ``counts`` has ai and n of the population and tp, fp, fn, tn of the validated part. Observed share, sensitivity and
    specificity are drawn from Jeffreys posteriors; a draw whose test is no better than chance has no share.
    """

    def draw(rng: np.random.Generator, size: int, r: tuple) -> dict:
        ai, n, tp, fp, fn, tn = r
        observed, sensitivity, specificity = (rng.beta(a + 0.5, b + 0.5, size) for a, b in ((ai, n - ai), (tp, fn), (tn, fp)))
        gain = sensitivity + specificity - 1
        share = np.clip((observed + specificity - 1) / np.where(gain > 0, gain, 1), 0, 1)
        return {"share": pd.Series(share).where(gain > 0, None).astype("Float64")}

    return _draws(counts, key, draws, seed, ["ai", "n", "tp", "fp", "fn", "tn"], "share double", draw)


def bootstrap_f1(rows: DataFrame, draws: int = 2000, seed: int = 7) -> DataFrame:
    """Interval of precision, recall and F1 when (p, y) rows are drawn again with replacement.

    The measures depend on the four cells of the table alone, and the cells of n rows drawn with replacement are one multinomial
    draw. So rows fold to four counts before anything is drawn, and the result has the same distribution as drawing rows.
    """
    p, y = F.coalesce("p", F.lit(False)), F.coalesce("y", F.lit(False))
    cells = rows.agg(F.lit("all").alias("key"), F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))

    def draw(rng: np.random.Generator, size: int, r: tuple) -> dict:
        n = sum(r)
        made = rng.multinomial(n, np.array(r) / n, size) if n else np.zeros((size, 4), np.int64)
        return {"tp": made[:, 0], "fp": made[:, 1], "fn": made[:, 2]}

    folds = _draws(cells, "key", draws, seed, ["tp", "fp", "fn", "tn"], "tp long, fp long, fn long", draw)
    precision, recall, f1 = precision_recall(F.col("tp"), F.col("fp"), F.col("fn"))
    values = folds.select(F.inline(F.array(*(F.struct(F.lit(name).alias("measure"), v.alias("v")) for name, v in (("precision", precision), ("recall", recall), ("f1", f1))))))
    return values.groupBy("measure").agg(F.percentile("v", 0.025).alias("lo"), F.percentile("v", 0.975).alias("hi"))
