"""Corpus pipeline: quality rules, quality classifier, near duplicates, packing; each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from centavo.llm import chosen_path, mil_quality, packing, quality_rules
from centavo.llm.common import stage, table


def _rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def _classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mil_quality.keep_good(docs, mil_quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return chosen_path.keep_first(docs)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, added=True)


STAGES = [("quality rules", _rules), ("quality classifier", _classifier), ("near duplicates", _near_duplicates), ("packing", _packing)]

#: The classifier, the join and the packing are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
