"""Landed explorer JSON, in two shapes, to one transaction form with input and output lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed formats: the fields read from each explorer.
ESPLORA = """
    txid string,
    status struct<block_time: bigint, block_height: bigint>,
    vin array<struct<txid: string, vout: bigint, prevout: struct<scriptpubkey_address: string, value: bigint>>>,
    vout array<struct<scriptpubkey_address: string, value: bigint>>
"""
BLOCKCYPHER = """
    hash string, confirmed string, block_height bigint,
    inputs array<struct<prev_hash: string, output_index: bigint, addresses: array<string>, output_value: bigint>>,
    outputs array<struct<addresses: array<string>, value: bigint>>
"""


def _blank_list(c: Column, like: str) -> Column:
    return F.coalesce(c, F.array().cast(like))


def _input(txid: Column, vout: Column, address: Column, value: Column) -> Column:
    return F.struct(txid.alias("txid"), vout.alias("vout"), address.alias("address"), value.alias("amount_sats"))


def _output(address: Column, value: Column) -> Column:
    return F.struct(address.alias("address"), value.alias("amount_sats"))


def positive(c: Column) -> Column:
    return F.when(c > 0, c)


def parse_time(c: Column) -> Column:
    """Epoch seconds from an integer or ISO-8601 text; null where neither fits."""
    number = F.when(c.rlike("^-?[0-9]+$"), positive(c.try_cast("long")))
    iso = F.when(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.unix_timestamp(F.try_to_timestamp(c)))
    return F.coalesce(number, iso)


def parse_esplora(raw: DataFrame, column: str = "json") -> DataFrame:
    """Coinbase inputs and data-only outputs stay, with a null address."""
    t = raw.select("*", F.from_json(column, ESPLORA).alias("t"))
    return t.select(
        *[c for c in raw.columns if c != column],
        F.col("t.txid").alias("tx_hash"),
        positive(F.col("t.status.block_time")).alias("timestamp"),
        F.col("t.status.block_height").alias("block_height"),
        _blank_list(
            F.transform("t.vin", lambda i: _input(i["txid"], i["vout"], i["prevout"]["scriptpubkey_address"], i["prevout"]["value"])),
            "array<struct<txid: string, vout: bigint, address: string, amount_sats: bigint>>",
        ).alias("inputs"),
        _blank_list(
            F.transform("t.vout", lambda o: _output(o["scriptpubkey_address"], o["value"])),
            "array<struct<address: string, amount_sats: bigint>>",
        ).alias("outputs"),
    )


def parse_blockcypher(raw: DataFrame, column: str = "json") -> DataFrame:
    """The first listed address of an input or output counts; heights of 0 and below mean unconfirmed."""
    t = raw.select("*", F.from_json(column, BLOCKCYPHER).alias("t"))
    first = lambda x: F.get(x["addresses"], F.lit(0))
    return t.select(
        *[c for c in raw.columns if c != column],
        F.col("t.hash").alias("tx_hash"),
        parse_time(F.col("t.confirmed")).alias("timestamp"),
        positive(F.col("t.block_height")).alias("block_height"),
        _blank_list(
            F.transform("t.inputs", lambda i: _input(i["prev_hash"], i["output_index"], first(i), i["output_value"])),
            "array<struct<txid: string, vout: bigint, address: string, amount_sats: bigint>>",
        ).alias("inputs"),
        _blank_list(
            F.transform("t.outputs", lambda o: _output(first(o), o["value"])),
            "array<struct<address: string, amount_sats: bigint>>",
        ).alias("outputs"),
    )


def to_esplora_json(txs: DataFrame) -> DataFrame:
    """The inverse of :func:`parse_esplora`, for landing files and round trips."""
    vin = F.transform("inputs", lambda i: F.struct(
        i["txid"].alias("txid"), i["vout"].alias("vout"),
        F.when(i["address"].isNotNull(), F.struct(i["address"].alias("scriptpubkey_address"), i["amount_sats"].alias("value"))).alias("prevout"),
    ))
    vout = F.transform("outputs", lambda o: F.struct(o["address"].alias("scriptpubkey_address"), o["amount_sats"].alias("value")))
    status = F.struct(F.col("timestamp").alias("block_time"), "block_height")
    return txs.select(F.to_json(F.struct(F.col("tx_hash").alias("txid"), status.alias("status"), vin.alias("vin"), vout.alias("vout"))).alias("json"))


def to_blockcypher_json(txs: DataFrame) -> DataFrame:
    addresses = lambda x: F.when(x["address"].isNotNull(), F.array(x["address"])).otherwise(F.array().cast("array<string>"))
    ins = F.transform("inputs", lambda i: F.struct(
        i["txid"].alias("prev_hash"), i["vout"].alias("output_index"), addresses(i).alias("addresses"), i["amount_sats"].alias("output_value")
    ))
    outs = F.transform("outputs", lambda o: F.struct(addresses(o).alias("addresses"), o["amount_sats"].alias("value")))
    confirmed = F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    height = F.coalesce("block_height", F.lit(-1)).alias("block_height")
    return txs.select(F.to_json(F.struct(F.col("tx_hash").alias("hash"), confirmed.alias("confirmed"), height, ins.alias("inputs"), outs.alias("outputs"))).alias("json"))
