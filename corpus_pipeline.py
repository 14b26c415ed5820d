"""A training corpus from raw documents: one stage after the other, each a table.

Every stage takes what its predecessor kept and returns the columns of documents; the
last one returns packed pieces.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, exchange, ngram_join, packing, pii, site_quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates: sets of five-word shingles, similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps.

    Null and empty texts are judged by their site and style alone; rows that repeat are
    judged alike; with no usable labels everything stays; an empty table gives none.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _documents(site_quality.keep_good(_documents(docs), labels))


def _chosen(docs: pa.Table, kept: pa.Table) -> pa.Table:
    """The rows of a group whose keys were kept."""
    return docs.filter(pc.is_in(docs.column("doc_id"), kept.column("doc_id").combine_chunks())).select(["named", *COLUMNS[1:]]).rename_columns(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that with the smallest id.

    Rows are judged each for itself: of rows that repeat one stays, a row of null id
    stays only if none of its group has an id, and rows without words link with nothing
    and stay.  An empty table gives none.
    """
    plan = exchange.Plan(docs)
    # links are between rows, so each gets a key of its own; texts are dealt to groups once and stored by group
    keyed = docs.select(F.monotonically_increasing_id().alias("doc_id"), F.col("doc_id").alias("named"), *COLUMNS[1:])
    rows = exchange.stored_groups(ngram_join.dealt(keyed, plan), plan.parts, "keyed")
    found = ngram_join.link_components(rows, SHINGLE, PERCENT, plan, stored=True)
    groups = found.select("doc_id", "component_id").join(rows.select("doc_id", "named", "g"), "doc_id")
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("named").isNull().alias("unnamed"), "named", "doc_id", "g")).alias("first"))
    kept = exchange.materialise(first.select("first.doc_id", "first.g"), "kept")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in _documents(docs).schema)
    return rows.groupBy("g").cogroup(kept.groupBy("g")).applyInArrow(_chosen, schema=fields)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Null and empty texts hold none and stay; rows that repeat are judged alike; with no
    benchmark rows everything stays; an empty table gives none.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _documents(decontamination.mark(_documents(docs), benchmark).where("n_hit = 0"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced; n_chars follows.

    Null texts stay null, with a null n_chars, and empty ones empty; rows that repeat are
    redacted alike; an empty table gives none.
    """
    out = pii.redact(_documents(docs))
    return _documents(out.withColumn("n_chars", F.length("text").cast("long")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences.

    A null or empty text is one piece that holds the end id alone; rows that repeat are
    packed each for itself; an empty table gives none.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("pii", redacted),
    ("packing", packed),
]

#: Boosted trees and compression of token ids have no SQL form; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written as Parquet and read again."""
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = exchange.materialise(stage(spark, out, sf_dir), f"stage-{name}")
    return out
