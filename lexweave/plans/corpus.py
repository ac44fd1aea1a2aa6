"""Queries of the core problems 1, 2, 4, 5 and 6, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators import hierarchy, history, incremental, integrity
from lexweave.session import table
from lexweave.streaming import changefeed


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.rebuild(spark, f"{d}/actions.parquet").select("target_id", "target_anchor", "action_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.changed_since_last_good(table(spark, d, "fingerprints"), table(spark, d, "runs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return integrity.orphans(table(spark, d, "sections"), table(spark, d, "actions"))


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return integrity.orphan_counts(table(spark, d, "sections"), table(spark, d, "actions"))


def _trees(spark: SparkSession, d: str, with_paths: bool) -> DataFrame:
    return hierarchy.forest({"nodes": hierarchy.node_links(table(spark, d, "nodes")), "sections": hierarchy.section_links(table(spark, d, "sections"))}, with_paths)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _trees(spark, d, with_paths=False).select("tree", "id", "root_id", "depth")


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    return _trees(spark, d, with_paths=True).select("tree", "id", "root_id", "depth", F.array_join("path", " > ").alias("path"), "back_edge")


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(_trees(spark, d, with_paths=True), "tree")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return history.section_history(table(spark, d, "sections"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p4_found, p4_counts, p5_found, p5_paths, p5_descendants, p6_found)}
