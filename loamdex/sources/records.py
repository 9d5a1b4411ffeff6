"""The audit's note records and clusters: versioned tables, swapped in whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .folder import SharedFolder

VERSION = 3
SCHEMA = "path string, mtime long, analyzed_at long, main_idea string, key_points array<string>, entities array<string>, quality string, suggested_tags array<string>, word_count int, topics array<string>, suggested_links array<string>, orphan boolean, mode string"
CLUSTERS = "seq long, name string, description string, moc string, path string, place int"


def load_records(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """Records of this version; none if the table is missing or of another version."""
    rows = SharedFolder(spark, path).table(schema + ", version int, updated_at timestamp")
    return rows.where(F.col("version") == VERSION).drop("version", "updated_at")


def save_records(records: DataFrame, path: str) -> None:
    """Write beside the table in force, then point to the new one: a crash leaves the old table or the new."""
    SharedFolder(records.sparkSession, path).save(records.withColumns({"version": F.lit(VERSION), "updated_at": F.current_timestamp()}))


def save_clusters(clusters: DataFrame, path: str) -> None:
    """Replace the clusters of the last audit; clusters: (seq, name, description, moc, paths). A row for each path, so that none grows."""
    rows = clusters.select("seq", "name", "description", "moc", F.posexplode_outer("paths").alias("place", "path"))
    save_records(rows.select("seq", "name", "description", "moc", "path", "place"), path)


def load_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(seq, name, description, moc, path, place) of the last audit; none if there was none."""
    return load_records(spark, path, CLUSTERS)
