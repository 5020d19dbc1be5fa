"""Record checks as columns: each yields the list of broken rules, empty for a good record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The record vocabularies and the transaction hash pattern.
SOURCES = ("elliptic", "blockstream", "blockcypher")
DIRECTIONS = ("in", "out")
TX_HASH = "^[0-9a-f]{64}$"


def _broken(**rules: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in rules.items()]))


def record_problems() -> Column:
    c = F.col
    dataset = c("source") == "elliptic"
    explorer = c("source").isin(*SOURCES[1:])
    return _broken(
        bad_source=c("source").isNull() | ~c("source").isin(*SOURCES),
        missing_dataset_id=dataset & (F.coalesce(c("elliptic_id"), F.lit("")) == ""),
        unexpected_tx_hash=dataset & c("tx_hash").isNotNull(),
        bad_tx_hash=explorer & ~F.coalesce(c("tx_hash").rlike(TX_HASH), F.lit(False)),
        unexpected_dataset_id=explorer & c("elliptic_id").isNotNull(),
        empty_address=F.coalesce(c("address"), F.lit("")) == "",
        bad_timestamp=c("timestamp") <= 0,
        bad_amount=c("amount_sats").isNull() | (c("amount_sats") <= 0),
        bad_direction=c("direction").isNull() | ~c("direction").isin(*DIRECTIONS),
        bad_height=c("block_height") < 0,
    )


def utxo_problems() -> Column:
    """Checks of a transaction with ``inputs`` and ``outputs`` lists."""
    c = F.col
    return _broken(
        bad_tx_hash=~F.coalesce(c("tx_hash").rlike(TX_HASH), F.lit(False)),
        bad_timestamp=c("timestamp") <= 0,
        bad_height=c("block_height") < 0,
        missing_inputs=c("inputs").isNull(),
        missing_outputs=c("outputs").isNull(),
        bad_input_txid=F.exists("inputs", lambda i: i["txid"].isNotNull() & ~i["txid"].rlike(TX_HASH)),
        bad_input_index=F.exists("inputs", lambda i: i["vout"] < 0),
        bad_input_amount=F.exists("inputs", lambda i: i["amount_sats"] < 0),
        bad_output_amount=F.exists("outputs", lambda o: o["amount_sats"] < 0),
    )


def split_by_problems(df: DataFrame, problems: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows with a ``problems`` list)."""
    checked = df.withColumn("problems", problems)
    return checked.where(F.size("problems") == 0).drop("problems"), checked.where(F.size("problems") > 0)


def problem_counts(df: DataFrame, problems: Column) -> DataFrame:
    return df.select(F.explode(problems).alias("problem")).groupBy("problem").agg(F.count("*").alias("records"))
