"""Readers and sinks: delimited dumps, feeds, incremental Parquet."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ventura.functions.text import canonicalize_domain, normalize_company_name
from ventura.sources.records import read_records


def read_delimited(spark: SparkSession, paths: str | list[str], columns: list[str], sep: str = "|", header: bool = True) -> DataFrame:
    """A dump with every column as text, BEL as quote, malformed rows dropped."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("sep", sep).option("header", header).option("quote", "\u0007").option("mode", "DROPMALFORMED").csv(paths)


def read_feeds(spark: SparkSession, csv: str | None = None, markdown: str | None = None, json: str | None = None, yaml: str | None = None) -> DataFrame:
    """Site addresses of several feed files, one row per registrable domain; the first feed in this order wins."""
    parts: list[DataFrame] = []
    if csv:
        parts.append(spark.read.option("header", True).csv(csv).select(F.col("url"), F.lit(1).alias("feed")))
    if markdown:
        found = F.regexp_extract_all(F.col("value"), F.lit(r"\]\((https?://[^)\s]+)\)"), 1)
        parts.append(spark.read.text(markdown).select(F.explode(found).alias("url"), F.lit(2).alias("feed")))
    if json:
        parts.append(spark.read.schema("url string").json(json).select("url", F.lit(3).alias("feed")))
    if yaml:
        sites = read_records(spark, yaml, "seed_urls array<string>")
        parts.append(sites.select(F.explode("seed_urls").alias("url"), F.lit(4).alias("feed")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.withColumn("domain", canonicalize_domain(F.col("url"))).filter("domain IS NOT NULL")
    return rows.groupBy("domain").agg(F.min(F.struct("feed", "url")).alias("first")).select("domain", "first.url", "first.feed")


SITE = "domain string, seed_urls array<string>, preferred_strategy string, fallback_order array<string>, quality_expectation_min_records int, last_success struct<at: string, strategy: string, record_count: int, valid_name_ratio: double, duplicate_ratio: double, completeness_score: double>, notes string"


def read_site_files(spark: SparkSession, folder: str, schema: str = SITE) -> DataFrame:
    """One row per YAML or JSON file: path and the fields of ``schema`` at any depth; absent fields are null, others ignored."""
    return read_records(spark, folder, schema)


def read_inferred(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A headered CSV with inferred types. Inference is one more pass over the files; give a schema where they are large."""
    return spark.read.option("header", True).option("inferSchema", True).csv(paths)


def fold_awards(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A bulk CSV of awards (company, award_year, company_website, state) folded into one record per firm.

    Firms are told apart by their normalised name, rows without one are dropped. The record has the count of awards, the
    first and last year, the distinct states in order, and the longest spelling and website of the earliest award that has
    any. Partial aggregation folds most rows before the shuffle, so no firm's awards are ever held together.
    """
    schema = "company string, award_year string, company_website string, state string"
    rows = spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(paths)
    rows = rows.withColumn("key", normalize_company_name(F.col("company"))).filter("key <> ''").withColumn("year", F.expr("try_cast(award_year AS INT)"))
    site = F.nullif(F.trim("company_website"), F.lit(""))
    return rows.groupBy("key").agg(
        F.max_by("company", F.struct(F.length("company"), "company")).alias("name"),
        F.count("*").alias("awards"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        F.min(F.when(site.isNotNull(), F.struct(F.coalesce("year", F.lit(9999)), site.alias("site"))))["site"].alias("website"),
        F.array_sort(F.collect_set("state")).alias("states"),
    )


def read_zip_member(spark: SparkSession, path: str, member: str, columns: list[str], sep: str = ";") -> DataFrame:
    """Rows of one headered CSV inside each zip file of ``path``, the named columns as text (null where the header lacks one).

    A zip can't be split, so a file is one task, of at most 2 GB packed; the member is unpacked as a stream.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for content in (c for b in batches for c in b["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                if member not in archive.namelist():
                    continue
                with archive.open(member) as raw:
                    for part in pd.read_csv(raw, sep=sep, dtype=str, keep_default_na=False, na_values=[""], chunksize=20_000, encoding="utf-8-sig"):
                        part = part.reindex(columns=columns)
                        yield part.astype(object).where(part.notna(), None)

    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, schema)


def grant_firms(spark: SparkSession, path: str, title: str) -> DataFrame:
    """Organisations of a grants archive that take part in a project whose title matches the pattern ``title``."""
    projects = read_zip_member(spark, path, "project.csv", ["id", "title"]).filter(F.lower("title").rlike(title))
    firms = read_zip_member(spark, path, "organization.csv", ["projectID", "name", "country", "organizationURL"])
    return firms.join(projects.select(F.col("id").alias("projectID")).hint("shuffle_hash"), "projectID", "left_semi")


def write_csv(df: DataFrame, path: str) -> None:
    """A small result as one headered file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_if_there(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame | None:
    """The Parquet folder, or None if nothing was ever written there. Other errors are raised."""
    try:
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append_new(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append the rows whose key isn't in the Parquet folder yet; returns what was appended. Null keys are one key."""
    spark = df.sparkSession
    there = read_if_there(spark, path)
    fresh = df.dropDuplicates(keys)
    if there is not None:
        old = there.select(*(F.col(k).alias(f"_old_{k}") for k in keys)).distinct()
        fresh = fresh.join(old, reduce(and_, (fresh[k].eqNullSafe(old[f"_old_{k}"]) for k in keys)), "left_anti")
    batch = uuid.uuid4().hex
    fresh.withColumn("_batch", F.lit(batch)).write.mode("append").parquet(path)
    return spark.read.parquet(path).filter(F.col("_batch") == batch).drop("_batch")


def distinct_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, size, first: which files hold what another of a smaller name holds already (dumps delivered twice have first <> path).

    Files of a size of their own are told apart without being read. Those that share a size are compared by a SHA-256 of their
    bytes; files over 2 GB can't be read whole and are taken by their name, so never as copies. Empty files are skipped.
    """
    files = spark.read.format("binaryFile").load(paths)
    sizes = files.select("path", F.col("length").alias("size"))
    shared = sizes.groupBy("size").agg(F.count("*").alias("n")).filter("n > 1").select("size")
    small = F.col("length") < 2**31 - 64
    digests = files.filter(small).join(shared, F.col("length") == F.col("size"), "left_semi").select("path", F.sha2("content", 256).alias("digest"))
    marked = sizes.join(digests, "path", "left").withColumn("print", F.coalesce("digest", F.col("path")))
    first = marked.groupBy("size", "print").agg(F.min("path").alias("first"))
    return marked.join(first, ["size", "print"]).select("path", "size", "first")


def has_columns(df: DataFrame, *names: str) -> bool:
    return set(names) <= set(df.columns)
