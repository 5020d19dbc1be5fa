"""Decoding and checks of dataset columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import ILLICIT, LICIT, UNKNOWN


def decode_label(raw: Column) -> Column:
    """Class text -> label code; null for an unknown class."""
    text = F.lower(F.trim(raw))
    return F.when(text == "1", ILLICIT).when(text == "2", LICIT).when(text == "unknown", UNKNOWN)


def is_labelled(label: Column) -> Column:
    return label.isin(ILLICIT, LICIT)


def time_step_of(features: Column) -> Column:
    """The step is the first feature."""
    return F.get(features, F.lit(0)).cast("int")
