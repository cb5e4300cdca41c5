"""The corpus pipeline: toxicity, quality rules, line dedup, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all rows its predecessor kept. All stages
but the last return the columns of ``documents``. ``run`` writes each stage's rows as Parquet under the shared folder and
reads them back for the next one, so a lost executor never repeats earlier stages.
"""

from __future__ import annotations

import uuid
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ventura.llm import line_dedup, ngram_jaccard, packing, quality_rules, toxicity
from ventura.llm.common import shared_dir, table


def _keep(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is in ``ids``; ids grow with the input, so they are dealt with the rows, not broadcast."""
    return docs.join(ids.select(F.col("doc_id").alias("_kept_id")).distinct().hint("shuffle_hash"), docs["doc_id"].eqNullSafe(F.col("_kept_id")), "left_semi")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5 stay. The models are fitted on this stage's rows and the labels of those not held out."""
    char_model, model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, char_model, model)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the list learned from labels.quality stay."""
    rules = quality_rules.learn(quality_rules.labelled_sample(docs, table(spark, sf_dir, "labels"), 1 - F.col("quality")))
    return quality_rules.keep_good(docs, rules)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; chunks of lines that repeat an earlier one go."""
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles with Jaccard of at least 0.8, the one of the smallest id stays."""
    found = ngram_jaccard.link_components(docs, 5, Fraction(4, 5))
    return _keep(docs, found.filter(F.col("component_id").eqNullSafe(F.col("doc_id"))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest, packed into sequences of at most 4096 ids of word_bpe_49k: one row per piece."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxic), ("quality_rules", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("packing", pack)]
#: Learned models and tokenizers can't be said in SQL; the tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
