"""Outcome and status columns. Each keeps "could not find out" apart from "found nothing"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import SOURCE_BAD_FORMAT, SOURCE_INDEXED, SOURCE_LIVE, SOURCE_NOT_FOUND


def attempt_kind(status: Column, timed_out: Column) -> Column:
    """Why one lookup attempt failed; null when it succeeded."""
    return (
        F.when(timed_out, "timeout")
        .when(status == 200, F.lit(None))
        .when(status == 429, "rate-limited")
        .when(status.isin(400, 404), "bad-address")
        .otherwise("api-error")
    )


def request_failure(status: Column, aborted: Column, retryable: Column, kind: Column) -> Column:
    """(source, kind) of a failed request: dataset miss, retryable, invalid input or fallback."""
    state = lambda source, k: F.struct(F.lit(source).alias("source"), k.alias("kind"))
    return (
        F.when(status == 404, state("pipeline", F.lit("dataset-miss")))
        .when(aborted, state("retryable", F.lit("timeout")))
        .when(
            (status == 429) | ((status == 503) & F.coalesce(retryable, F.lit(False))),
            state("retryable", F.coalesce(kind, F.when(status == 429, "rate-limited").otherwise("api-error"))),
        )
        .when(status.isin(400, 422), state("invalid-input", F.coalesce(kind, F.lit("invalid-request"))))
        .when(status.isNotNull(), state("fallback", F.lit("service-error")))
        .otherwise(state("fallback", F.lit("unreachable")))
    )


def poll_failure_kind(status: Column, timed_out: Column, is_list: Column) -> Column:
    """Why a poll could not be answered; null for a usable list."""
    return (
        F.when(timed_out, "timeout")
        .when(status.isNull(), "unreachable")
        .when(status == 429, "rate-limited")
        .when((status != 200) | ~F.coalesce(is_list, F.lit(False)), "api-error")
    )


def poll_status(alert: Column, reason: Column, last_ok: Column) -> tuple[Column, Column]:
    """Row status of a watched wallet, and how fresh it is."""
    status = (
        F.when(alert.isNotNull(), "UNCONFIRMED TX")
        .when(reason.isNotNull(), F.concat(F.lit("CHECK FAILED ("), reason, F.lit(")")))
        .otherwise("Idle / Monitoring")
    )
    freshness = (
        F.when(last_ok.isNotNull(), "checked")
        .when(reason.isNotNull(), "never checked successfully")
        .otherwise("not yet polled")
    )
    return status, freshness


def source_of(indexed: Column, valid: Column, has_history: Column) -> Column:
    """Where a wallet's answer comes from; the index wins over the address checks."""
    return (
        F.when(indexed, SOURCE_INDEXED)
        .when(~valid, SOURCE_BAD_FORMAT)
        .when(has_history, SOURCE_LIVE)
        .otherwise(SOURCE_NOT_FOUND)
    )


def case_outcome(request_source: Column, source: Column, failure: Column, has_rules: Column, has_verdict: Column) -> Column:
    """One outcome per reported wallet; the order keeps failures from reading as answers."""
    return (
        F.when(request_source == "retryable", "retryable")
        .when(request_source == "invalid-input", "invalid_input")
        .when(request_source == "fallback", "fallback")
        .when(source == SOURCE_BAD_FORMAT, "empty")
        .when(failure.isNotNull(), "retryable")
        .when(F.coalesce(source, F.lit(SOURCE_NOT_FOUND)) == SOURCE_NOT_FOUND, "empty")
        .when(~(has_rules & has_verdict), "incomplete")
        .otherwise("pipeline")
    )


def case_risk_level(verdict: Column) -> Column:
    return F.when(verdict == "confirmed", "CRITICAL").when(verdict == "watch", "ELEVATED").otherwise("LOW")


def display_flag(score: Column) -> Column:
    return F.when(score >= 60, "high").when(score > 0, "low").otherwise("none")


def laundering_marker(peel: Column, fan: Column, mixer: Column) -> Column:
    return F.when(peel, "PeelChain").when(fan, "FanOut").when(mixer, "MixerHop").otherwise("Standard")


def attribution_status(name: Column, lookup_failed: Column) -> Column:
    """A failed lookup is never reported as "no match"."""
    return F.when(name.isNotNull(), "matched").when(lookup_failed, "lookup-failed").otherwise("no-match")
