"""Corpus pipeline: stages over documents, each written and read again by the next.

Every stage takes the columns of documents, nulls in any of them, empty texts,
repeated rows and ids, and an empty table, which gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspark.llm import mixing, ngram_join, packing, quality_rules, secret_scan
from quillspark.llm.common import shared_dir


def quality(spark, docs, sf_dir):
    """Documents that pass the quality rules; those with a null or empty text don't."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document, that of the least id, of each group of near duplicates.

    Rows of one id are one document: its different texts stay or go together,
    and of its rows with one text the one whose other columns come first stays.
    Rows without an id are in no group and stay.
    """
    found = ngram_join.join(docs)
    rest = found.where("component_id < doc_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(rest, "doc_id", "left_anti")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    named = named.groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("__others"))
    return named.select(*(F.col(f"__others.{c}").alias(c) if c in others else F.col(c) for c in docs.columns)).unionByName(docs.where("doc_id is null"))


def secrets(spark, docs, sf_dir):
    """Every document, its secrets masked; null texts stay null."""
    return secret_scan.mask(docs)


def mix(spark, docs, sf_dir):
    """The words that the mix takes: a row for each round that takes some of a document.

    Texts that are taken whole stay as they are; of one that is taken in part
    the words are joined by single spaces. Null is a source of its own.
    """
    return mixing.mixed(docs)


def pack(spark, docs, sf_dir):
    """Every piece of every document with its bin; a text without words has a place and takes no room."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

#: SQL can't express the stages' choices; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    place = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.mode("overwrite").parquet(f"{place}/{i}")
            docs = spark.read.parquet(f"{place}/{i}")
    return docs
