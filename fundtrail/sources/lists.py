"""Line-oriented lists: mixers, exchange tags and bulk complaints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import inr_to_btc
from ..operators.ranking import global_rank
from ..session import path_exists


def read_lines(spark: SparkSession, path) -> DataFrame:
    """(position, line). Lines are numbered file by file in path order and downwards in each file.

    Spark deals files out by size, so the number of a line within its read says nothing across files.
    """
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"),
    )
    return global_rank(rows, [F.col("file"), F.col("block"), F.col("place")], "position").select("position", "line")


def _content(lines: DataFrame) -> DataFrame:
    """Trimmed lines without blanks and comments."""
    return lines.withColumn("line", F.trim("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))


def parse_mixers(lines: DataFrame) -> DataFrame:
    return _content(lines).select(F.col("line").alias("mixer_id")).distinct()


def _fields(lines: DataFrame) -> DataFrame:
    part = lambda i: F.nullif(F.trim(F.get(F.split("line", ","), F.lit(i))), F.lit(""))
    return _content(lines).select(
        "*", part(0).alias("address"), part(1).alias("name"), part(2).alias("_source"), part(3).alias("jurisdiction")
    )


def parse_exchange_tags(lines: DataFrame) -> DataFrame:
    """(address, name, source, jurisdiction, position) of well-formed lines."""
    return _fields(lines).where("address is not null and name is not null").select(
        "address", "name", F.coalesce("_source", F.lit("unsourced")).alias("source"), "jurisdiction", "position"
    )


def rejected_tags(lines: DataFrame) -> DataFrame:
    return _fields(lines).where("address is null or name is null").select("position", "line")


def parse_bulk_complaints(lines: DataFrame) -> DataFrame:
    """Addresses of a bulk intake: one per line, longer than ten characters."""
    return lines.select(F.trim("line").alias("suspect_address")).where(F.length("suspect_address") > 10)


def complaints(rows: DataFrame) -> DataFrame:
    """Single intake rows: rupee amounts default to 100000 and are given in bitcoin too."""
    inr = F.when(F.coalesce("amount_inr", F.lit(0.0)) != 0, F.col("amount_inr")).otherwise(F.lit(100000.0))
    return rows.where(F.trim("suspect_address") != "").select(
        "ack_number", "victim_state", "scam_category", F.trim("suspect_address").alias("suspect_address"),
        inr.alias("amount_inr"), inr_to_btc(inr).alias("amount_btc"),
    )


def read_mixers(spark: SparkSession, path: str | None) -> DataFrame:
    """An absent list is an empty list."""
    return parse_mixers(spark.read.text(path).select(F.col("value").alias("line"))) if path_exists(spark, path) else spark.createDataFrame([], "mixer_id string")


def read_exchange_tags(spark: SparkSession, path: str | None) -> DataFrame:
    if path_exists(spark, path):
        return parse_exchange_tags(read_lines(spark, path))
    return spark.createDataFrame([], "address string, name string, source string, jurisdiction string, position long")

