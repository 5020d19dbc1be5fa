"""Tables and reports the engine writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_normalised(path: str, nodes: DataFrame, edges: DataFrame, split: DataFrame) -> None:
    """txs, edges and entity_split tables; transactions clustered by id for point lookups."""
    nodes.repartitionByRange("tx_id").sortWithinPartitions("tx_id").write.mode("overwrite").parquet(f"{path}/txs")
    edges.select("src", "dst").write.mode("overwrite").parquet(f"{path}/edges")
    split.write.mode("overwrite").parquet(f"{path}/entity_split")


def read_normalised(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{t}") for t in ("txs", "edges", "entity_split"))


def save_cluster_report(path: str, clusters: DataFrame, totals: DataFrame) -> None:
    clusters.write.mode("overwrite").json(f"{path}/clusters")
    totals.write.mode("overwrite").json(f"{path}/totals")


def load_cluster_report(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(f"{path}/clusters")


def append_audit(path: str, report: DataFrame, run_id: str) -> None:
    """One line per run, with the time of writing; earlier runs stay."""
    report.withColumns({"run_id": F.lit(run_id), "written_at": F.current_timestamp()}).coalesce(1).write.mode("append").json(path)


def latest_audit(spark: SparkSession, path: str, schema) -> DataFrame:
    """The run written last, whatever its id."""
    runs = spark.read.schema(T.StructType([*schema.fields, T.StructField("written_at", T.TimestampType())])).json(path)
    return runs.orderBy(F.desc("written_at")).limit(1).drop("written_at")


def write_ledger_csv(path: str, ledger: DataFrame) -> None:
    ledger.write.mode("overwrite").option("header", True).csv(path)


def write_case_json(path: str, documents: DataFrame) -> None:
    documents.select("document").write.mode("overwrite").text(path)
