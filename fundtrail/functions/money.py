"""Satoshi, bitcoin and rupee conversions, fee rates and hop-depth limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import BTC_TO_INR, SATS_PER_BTC


def sats_to_btc(sats: Column) -> Column:
    return (sats.cast("decimal(20,0)") / F.lit(SATS_PER_BTC).cast("decimal(10,0)")).cast("decimal(20,8)")


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def sats_to_inr(sats: Column, rate: int = BTC_TO_INR) -> Column:
    return round_half_up(sats / SATS_PER_BTC * rate)


def inr_to_btc(inr: Column, rate: int = BTC_TO_INR) -> Column:
    return F.round(inr / rate, 4)


def fee_rate(fee: Column, weight: Column) -> Column:
    return F.when(weight > 0, round_half_up(fee / weight * 4)).otherwise(F.lit(0).cast("long"))


def clamp_hops(hops: Column) -> Column:
    return F.least(F.greatest(hops, F.lit(1)), F.lit(10))
