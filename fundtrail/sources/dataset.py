"""The labelled dataset: feature, class and edge CSV files, and the optional address map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import decode_label, time_step_of
from ..params import N_FEATURES
from ..session import materialize


class DatasetError(ValueError):
    pass


def find_files(spark: SparkSession, root: str, *keywords: str) -> list[str]:
    """CSV files below ``root`` whose name holds every keyword, in path order, leaving out any
    path with "actors dataset" in it. Only names are listed; nothing is read. A folder named
    ``*.csv`` is one dataset made of part files."""
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(base):
        raise FileNotFoundError(f"no such folder: {root}")
    found, listing = set(), fs.listFiles(base, True)
    while listing.hasNext():
        path = listing.next().getPath()
        if path.getParent().getName().lower().endswith(".csv"):
            path = path.getParent()
        name, full = path.getName().lower(), path.toString()
        if name.endswith(".csv") and all(k.lower() in name for k in keywords) and "actors dataset" not in full.lower():
            found.add(full)
    return sorted(found)


def matching_files(spark: SparkSession, root: str, *keywords: str) -> list[str]:
    """All CSV files with the keywords in their names, which are read as one table; at least one."""
    files = find_files(spark, root, *keywords)
    if not files:
        raise FileNotFoundError(f"no CSV with {keywords} in its name under {root}")
    return files


def scan_features(spark: SparkSession, path, n_features: int = N_FEATURES) -> DataFrame:
    """Header-less CSV: id and exactly ``n_features`` numbers per row, or the read fails."""
    names = [f"f{i}" for i in range(n_features)]
    schema = T.StructType(
        [T.StructField("tx_id", T.StringType())] + [T.StructField(n, T.FloatType()) for n in names]
    )
    rows = spark.read.csv(path, schema=schema, header=False, mode="FAILFAST")
    return rows.select("tx_id", F.array(*names).alias("features"))


def check_feature_width(spark: SparkSession, path, n_features: int = N_FEATURES) -> DataFrame:
    """Number of lines per column count other than the expected one; empty for a good file."""
    width = F.size(F.split("value", ",")).alias("columns")
    return spark.read.text(path).select(width).where(F.col("columns") != n_features + 1).groupBy("columns").count()


def scan_labels(spark: SparkSession, path) -> DataFrame:
    """(tx_id, class, label); an unknown class leaves the label null."""
    raw = spark.read.csv(path, schema="tx_id string, class string", header=True)
    return raw.select("tx_id", "class", decode_label(F.col("class")).alias("label"))


def bad_classes(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("label").isNull()).select("class").distinct()


def scan_edges(spark: SparkSession, path) -> DataFrame:
    return spark.read.csv(path, schema="src string, dst string", header=True)


def scan_address_map(spark: SparkSession, root: str) -> DataFrame:
    """(address, tx_id) from all address and actor files that have both columns; empty where there is none.

    Column names are matched without regard to case.
    """
    found = spark.createDataFrame([], "address string, tx_id string")
    for path in sorted(set(find_files(spark, root, "addr") + find_files(spark, root, "actor"))):
        df = spark.read.csv(path, header=True)
        by_name = {c.lower(): c for c in df.columns}
        if {"address", "tx_id"} <= set(by_name):
            found = found.union(df.select(by_name["address"], by_name["tx_id"]))
    return found


def id_set_diff(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Ids in one table only, with the side that has them."""
    f, l = features.select("tx_id").distinct(), labels.select("tx_id").distinct()
    return f.exceptAll(l).withColumn("only_in", F.lit("features")).unionByName(
        l.exceptAll(f).withColumn("only_in", F.lit("labels"))
    )


def align_features(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Nodes: label, step and features per id. Both inputs must hold the same ids."""
    return features.join(labels.select("tx_id", "label"), "tx_id").select(
        "tx_id", "label", time_step_of(F.col("features")).alias("time_step"), "features"
    )


def alignment_counts(features: DataFrame, labels: DataFrame) -> DataFrame:
    """How many ids match and how many are on one side only."""
    f = features.select("tx_id", F.lit(1).alias("f"))
    both = f.join(labels.select("tx_id", F.lit(1).alias("l")), "tx_id", "full")
    return both.agg(
        F.count_if(F.expr("f = 1 and l = 1")).alias("matched"),
        F.count_if(F.expr("l is null")).alias("features_only"),
        F.count_if(F.expr("f is null")).alias("labels_only"),
    )


def load_dataset(spark: SparkSession, root: str, n_features: int = N_FEATURES) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from a folder, typed and joined in the one pass that reads the files.

    Whatever a check needs is written beside the rows, and the checks count on that table, of which they read a few narrow columns.
    Counts so stay exact when tasks run twice. A table that fails a check is not returned.
    """
    names = [f"f{i}" for i in range(n_features)]
    typed = ", ".join(["tx_id string", *[f"{n} float" for n in names], "_line string"])
    rows = spark.read.csv(matching_files(spark, root, "features"), schema=typed, header=False, mode="PERMISSIVE", columnNameOfCorruptRecord="_line")
    features = rows.select("tx_id", F.array(*names).alias("features"), "_line", F.lit(True).alias("_featured"))
    labels = scan_labels(spark, matching_files(spark, root, "classes")).withColumn("_classed", F.lit(True))
    edge_files = matching_files(spark, root, "edgelist")
    width = F.size(F.split("_line", ","))
    wrong = F.col("_line").isNotNull() & (width != n_features + 1)
    strange = F.col("_classed") & F.col("label").isNull()
    full = features.join(labels, "tx_id", "full").withColumn("time_step", time_step_of(F.col("features")))
    rows = materialize(full, "dataset-nodes")
    found = rows.agg(
        F.count_if(wrong).alias("wrong"), F.min(F.when(wrong, width)).alias("width"), F.count("_line").alias("unread"), F.min("_line").alias("line"),
        F.count_if(strange).alias("strange"), F.min(F.when(strange, F.coalesce("class", F.lit("")))).alias("class"),
        F.count_if(F.col("_classed").isNull()).alias("features_only"), F.count_if(F.col("_featured").isNull()).alias("labels_only"),
    ).first()
    if found["wrong"]:
        raise DatasetError(f"expected {n_features + 1} columns, found {found['width']}")
    if found["unread"]:
        raise DatasetError(f"{found['unread']} feature lines that don't parse, among them {found['line'][:80]!r}")
    if found["strange"]:
        raise DatasetError(f"{found['strange']} rows with unrecognised class labels, among them {found['class']!r}")
    if found["features_only"] or found["labels_only"]:
        raise DatasetError(f"{found['features_only']} ids only in the feature files, {found['labels_only']} only in the class files")
    return rows.select("tx_id", "label", "time_step", "features"), materialize(scan_edges(spark, edge_files), "dataset-edges")
