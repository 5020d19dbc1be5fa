"""Combine the rule signal and the learned signal into one verdict per wallet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import VERDICT_CONFIRMED, VERDICT_NONE, VERDICT_WATCH


def verdict_of(rule_flagged: Column, learned_flagged: Column) -> Column:
    rule = F.coalesce(rule_flagged, F.lit(False))
    learned = F.coalesce(learned_flagged, F.lit(False))
    return (
        F.when(rule & learned, VERDICT_CONFIRMED).when(rule | learned, VERDICT_WATCH).otherwise(VERDICT_NONE)
    )


def correlate(rules: DataFrame, learned: DataFrame) -> DataFrame:
    """``rules`` has one row per wallet; ``learned`` may lack wallets, which are unclassified."""
    joined = rules.join(learned, "tx_id", "left").withColumns(
        {
            "classified": F.coalesce("classified", F.lit(False)),
            "learned_flag": F.coalesce("learned_flag", F.lit(False)),
            "rule_flagged": F.size("rules_fired") > 0,
        }
    )
    return joined.withColumn("verdict", verdict_of(F.col("rule_flagged"), F.col("learned_flag")))


def live_verdict_cap(verdicts: DataFrame, indexed: Column) -> DataFrame:
    """Wallets outside the training index have one signal only, so they stop at ``watch``."""
    over = ~indexed & (F.col("verdict") == VERDICT_CONFIRMED)
    return verdicts.withColumns(
        {
            "verdict": F.when(over, VERDICT_WATCH).otherwise(F.col("verdict")),
            "correlation_cap": F.when(~indexed, "capped at watch: one independent signal"),
        }
    )


def correlation_invariants(verdicts: DataFrame) -> DataFrame:
    """Violations per rule; every count must be zero except for the informative last one."""
    v, rule, learned = F.col("verdict"), F.col("rule_flagged"), F.col("learned_flag")
    return verdicts.agg(
        F.count_if((v == VERDICT_CONFIRMED) & ~(rule & learned)).alias("confirmed_without_both"),
        F.count_if((v != VERDICT_NONE) & ~(rule | learned)).alias("raised_without_signal"),
        F.count_if((v == VERDICT_NONE) & (rule | learned)).alias("signal_dropped"),
        F.count_if((v == VERDICT_CONFIRMED) & (F.col("label") == 0)).alias("known_licit_confirmed"),
    )


def signal_overlap(verdicts: DataFrame) -> DataFrame:
    """Agreement of the signals and recall and precision of each, over labelled wallets."""
    rule, learned = F.col("rule_flagged"), F.col("learned_flag")
    bad = F.col("label") == 1
    counts = verdicts.where(F.col("label").isin(0, 1)).agg(
        F.count_if(rule & learned).alias("both"),
        F.count_if(rule & ~learned).alias("rule_only"),
        F.count_if(~rule & learned).alias("learned_only"),
        F.count_if(bad).alias("illicit"),
        F.count_if(bad & rule).alias("illicit_rule"),
        F.count_if(bad & learned).alias("illicit_learned"),
        F.count_if(bad & (rule | learned)).alias("illicit_union"),
    )
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    c = F.col
    return counts.select(
        "*",
        share(c("illicit_rule"), c("illicit")).alias("rule_recall"),
        share(c("illicit_learned"), c("illicit")).alias("learned_recall"),
        share(c("illicit_union"), c("illicit")).alias("union_recall"),
        share(c("illicit_rule"), c("both") + c("rule_only")).alias("rule_precision"),
        share(c("illicit_learned"), c("both") + c("learned_only")).alias("learned_precision"),
    )


def verdict_breakdown(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("label", "verdict").agg(F.count("*").alias("wallets"))
