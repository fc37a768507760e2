"""Documents to packed training sequences: quality rules, near-dedup, decontamination, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltline.llm import decontaminate, packing, quality, secrets, simhash
from siltline.llm.common import removed, scratch, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id stays."""
    return simhash.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced; the documents stay."""
    return secrets.redacted(docs, repository=secrets.repository_of(docs), most_owners=secrets.WIDELY, most_repositories=secrets.WIDELY)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its sequence and place there."""
    return packing.pack(docs)


STAGES = [(f.__name__, f) for f in (quality_rules, simhash_near_dedup, benchmark_decontamination, secret_scans, best_fit_packing)]

#: Near-dedup's components and packing are no SQL: tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again.

    What a stage makes for itself belongs to this run and goes once the stage's result is written, and so does what it read;
    what the returned frame reads stays until the driver ends, so any number of runs may be read later.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, of in STAGES[:-1]:
        with scratch(spark):
            docs = written(of(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
        if before is not None:
            removed(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
