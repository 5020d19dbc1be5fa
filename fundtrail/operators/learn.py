"""The learned signal: balanced weights, a random forest, its evaluation and scoring."""

from __future__ import annotations

import time
from functools import reduce
from operator import add

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import is_labelled
from ..params import Params
from ..session import materialize, scratch_path
from .ranking import one_row

#: Rows times trees that one fit keeps at most, unless that leaves fewer than GROUP_TREES trees to a fit.
FIT_CELLS = 400_000_000
GROUP_TREES = 25

#: Rows that a task fits on at most.
FIT_ROWS = 100_000


def train_split(nodes: DataFrame, split: DataFrame) -> DataFrame:
    """Labelled rows of the train and test splits; val and unknown labels are left out."""
    return nodes.where(is_labelled(F.col("label"))).join(
        split.where(F.col("split").isin("train", "test")).select("tx_id", "split"), "tx_id"
    )


def class_weights(labelled: DataFrame) -> DataFrame:
    """Balanced weight n / (classes * class count), worked out from the class counts alone."""
    counts = labelled.groupBy("label").agg(F.count("*").alias("rows"))
    both = Window.partitionBy()  # one row per class
    weight = F.sum("rows").over(both) / (F.count("*").over(both) * F.col("rows"))
    return counts.select("label", "rows", F.round(weight, 6).alias("weight"))


def tree_groups(rows: int, trees: int) -> list[int]:
    """How many trees each fit takes, so that rows times trees stay within FIT_CELLS. Groups are of about one size and of GROUP_TREES at least."""
    size = max(GROUP_TREES, FIT_CELLS // max(rows, 1))
    n = max(1, min(-(-trees // size), trees // GROUP_TREES))
    return [trees // n + (i < trees % n) for i in range(n)]


def train_model(rows: DataFrame, params: Params) -> PipelineModel:
    """Fit on (label 0/1, features array). The row weight makes both classes weigh the same.

    MLlib keeps each row with its count in every tree of a fit. Of many rows the forest is fitted a group of trees after the
    other, each a stage of the model, over partitions of at most FIT_ROWS rows, so neither outgrows an executor.
    ``rows`` are read several times and should be a stored table.
    """
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # two classes
    total = sum(counts.values())
    weights = {label: total / (2 * n) for label, n in counts.items()}
    weighted = rows.select(
        F.col("label").cast("double").alias("target"),
        array_to_vector(F.col("features").cast("array<double>")).alias("vector"),
        F.when(F.col("label") == 1, weights.get(1, 1.0)).otherwise(weights.get(0, 1.0)).alias("row_weight"),
    )
    large = total > FIT_ROWS * rows.sparkSession.sparkContext.defaultParallelism
    if large:
        weighted = weighted.repartition(-(-total // FIT_ROWS)).persist(StorageLevel.DISK_ONLY)
    forests = [
        RandomForestClassifier(
            labelCol="target", featuresCol="vector", weightCol="row_weight",
            predictionCol=f"prediction{i}", probabilityCol=f"probability{i}", rawPredictionCol=f"votes{i}",
            numTrees=trees, seed=params.seed + i, maxDepth=params.forest_depth,
        )
        for i, trees in enumerate(tree_groups(total, params.forest_trees))
    ]
    model = Pipeline(stages=forests).fit(weighted)
    if large:
        weighted.unpersist()
    return model


def predict_risk(model: PipelineModel, features: DataFrame) -> DataFrame:
    """(tx_id, risk): probability of the illicit class for every row."""
    vectors = features.select("tx_id", array_to_vector(F.col("features").cast("array<double>")).alias("vector"))
    shares = [vector_to_array(f"probability{i}")[1] * F.lit(float(f.getNumTrees)) for i, f in enumerate(model.stages)]
    trees = sum(f.getNumTrees for f in model.stages)
    return model.transform(vectors).select("tx_id", (reduce(add, shares) / trees).alias("risk"))


def forest_table(model: PipelineModel) -> DataFrame:
    """The forest as rows (tree, node, feature, threshold, left, right, value, levels).

    ``value`` is the illicit share of the weight at a node, ``feature`` is null at leaves, and node 0 is a tree's root.
    ``levels`` is the longest way down, the same on all rows. The rows come from the files a model is saved in.
    """
    spark = SparkSession.active()
    node, stats = F.col("nodeData"), F.col("nodeData.impurityStats")
    inner = node["leftChild"] >= 0
    levels = max(t.depth for forest in model.stages for t in forest.trees)
    tables, first = [], 0
    for forest in model.stages:
        path = scratch_path(spark, "forest")
        forest.save(path)
        tables.append(spark.read.load(f"{path}/data").select(
            (F.col("treeID") + first).alias("tree"), node["id"].alias("node"),
            F.when(inner, node["split"]["featureIndex"]).alias("feature"),
            F.when(inner, F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
            F.when(inner, node["leftChild"]).alias("left"), F.when(inner, node["rightChild"]).alias("right"),
            (F.coalesce(F.get(stats, F.lit(1)), F.lit(0.0)) / F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)).alias("value"),
            F.lit(levels).alias("levels"),
        ))
        first += forest.getNumTrees
    return reduce(DataFrame.unionByName, tables)


def forest_risk(forest: DataFrame, features: DataFrame) -> DataFrame:
    """(tx_id, risk) by joins with the forest's rows, level by level.

    Every row starts at each tree's root and steps to a child until it stands at a leaf; its risk is the mean of the leaves' values.
    A forest that Spark finds small enough is broadcast, and rows then meet all levels in one stage; of a larger one the joins
    go by (tree, node). Rows without features are left out, as they cannot be scored.
    """
    levels = forest.agg(F.max("levels")).first()[0] or 0
    trees = forest.select("tree").distinct().agg(F.sort_array(F.collect_list("tree"))).first()[0]  # a number for each tree
    vectors = features.where(F.col("features").isNotNull()).select("tx_id", F.col("features").cast("array<double>").alias("x"))
    at = vectors.select("tx_id", "x", F.explode(F.array(*[F.lit(t) for t in trees])).alias("tree"), F.lit(0).alias("node"))
    inner = forest.where("feature is not null").select("tree", "node", "feature", "threshold", "left", "right")
    for _ in range(levels):
        step = F.when(F.col("feature").isNull(), F.col("node")).when(F.get("x", F.col("feature")) <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
        at = at.join(inner, ["tree", "node"], "left").select("tx_id", "x", "tree", step.alias("node"))
    leaves = forest.select("tree", "node", "value")
    return at.join(leaves, ["tree", "node"]).groupBy("tx_id").agg(F.avg("value").alias("risk"))


def learned_signal(wallets: DataFrame, risks: DataFrame, params: Params) -> DataFrame:
    """Wallets without features stay unclassified: no risk, no flag. The flag uses the unrounded risk."""
    known = F.col("risk").isNotNull()
    flag = F.coalesce(F.col("risk") >= params.learned_threshold, F.lit(False))
    return wallets.select("tx_id").join(risks.select("tx_id", "risk"), "tx_id", "left").select(
        "tx_id",
        known.alias("classified"),
        F.round("risk", 6).alias("risk_score"),
        F.when(known, F.when(flag, "illicit").otherwise("licit")).alias("prediction"),
        flag.alias("learned_flag"),
        F.lit(params.learned_threshold).alias("flag_threshold"),
    )


def eval_metrics(scored: DataFrame, threshold: float) -> DataFrame:
    """One row from (label, risk): confusion counts and rates, 0 where a rate has no base."""
    hit, bad = F.col("risk") >= threshold, F.col("label") == 1
    c = scored.agg(
        F.count("*").alias("n_test"),
        F.count_if(hit & bad).alias("tp"), F.count_if(hit & ~bad).alias("fp"),
        F.count_if(~hit & bad).alias("fn"), F.count_if(~hit & ~bad).alias("tn"),
    )
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(
        "n_test", "tp", "fp", "fn", "tn",
        rate(tp, tp + fn).alias("illicit_recall"),
        rate(tp, tp + fp).alias("illicit_precision"),
        rate(2 * tp, 2 * tp + fp + fn).alias("illicit_f1"),
        rate(tp + tn, F.col("n_test")).alias("accuracy"),
        F.lit(threshold).alias("flag_threshold"),
    )


def train_and_evaluate(nodes: DataFrame, split: DataFrame, params: Params, model_path: str | None = None, report_path: str | None = None) -> tuple[PipelineModel, DataFrame]:
    """Train on the train split, evaluate on the test split, and persist both if paths are given.

    The one-row report carries the parameters next to the metrics.
    """
    rows = materialize(train_split(nodes, split).select("tx_id", "label", "features", "split"), "learn")
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    began = time.time()
    model = train_model(train, params)
    seconds = time.time() - began
    scored = test.join(predict_risk(model, test), "tx_id")
    sizes = rows.agg(
        F.count_if(F.expr("split = 'train'")).alias("n_train_txids"),
        F.count_if(F.expr("split = 'test' and label = 1")).alias("n_illicit_test"),
        F.count_if(F.expr("split = 'train' and label = 1")).alias("n_illicit_train"),
    )
    report = one_row(eval_metrics(scored, params.learned_threshold), sizes).select(
        "*",
        F.lit("random_forest").alias("model"),
        F.lit(params.forest_trees).alias("n_estimators"),
        F.lit(params.forest_depth).alias("max_depth"),
        F.lit(params.seed).alias("seed"),
        F.lit(round(seconds, 3)).alias("training_seconds"),
        F.current_timestamp().alias("trained_at"),
        F.round(F.col("n_train_txids") / (2 * F.col("n_illicit_train")), 6).alias("weight_illicit"),
        F.round(F.col("n_train_txids") / (2 * (F.col("n_train_txids") - F.col("n_illicit_train"))), 6).alias("weight_licit"),
    )
    if model_path:
        forest_table(model).write.mode("overwrite").parquet(model_path)
    if report_path:
        report.write.mode("overwrite").json(report_path)
    return model, report


def load_model(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a stored forest, for :func:`forest_risk`."""
    return spark.read.parquet(path)


def forest_faults(forest: DataFrame, n_features: int) -> DataFrame:
    """One row of counts over a stored forest: trees, and rows that no tree can have."""
    children = forest.where("feature is not null").select("tree", F.explode(F.array("left", "right")).alias("node"))
    named = children.groupBy("tree", "node").agg(F.count("*").alias("n"))
    rows = forest.join(named, ["tree", "node"], "full_outer")
    root = F.col("node") == 0
    return rows.agg(
        F.countDistinct("tree").alias("trees"),
        (F.count_if(F.col("feature").isNull()) - F.count("feature")).alias("leaves_less_inner"),
        F.count_if(F.col("value").isNull() | ~F.coalesce("value", F.lit(0.0)).between(0, 1)).alias("bad_values"),
        F.count_if((root & F.col("n").isNotNull()) | (~root & (F.coalesce("n", F.lit(0)) != 1))).alias("bad_links"),
        F.count_if(F.col("feature").isNotNull() & (~F.col("feature").between(0, n_features - 1) | F.col("threshold").isNull())).alias("bad_splits"),
    )


def audit_sample(nodes: DataFrame, seed: int, n_licit: int = 25, n_illicit: int = 25, n_any: int = 60) -> DataFrame:
    """Seeded sample per stratum, ordered by hash so that it never depends on partitioning."""
    key = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("tx_id").cast("string")).cast("binary"))
    take = lambda rows, n, name: rows.orderBy(key, "tx_id").limit(n).select(F.lit(name).alias("stratum"), "tx_id", "label")
    return (
        take(nodes.where("label = 0"), n_licit, "licit")
        .unionByName(take(nodes.where("label = 1"), n_illicit, "illicit"))
        .unionByName(take(nodes, n_any, "any"))
    )
