"""Thresholds of the tracing rules, kept in one frozen object so that every report can echo them."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, replace

# Label codes, rule names, verdicts and confidence tiers.
ILLICIT, LICIT, UNKNOWN = 1, 0, -1
RULE_PEEL = "peel_chain"
RULE_FANOUT = "rapid_fan_out"
RULE_MIXER = "mixer_adjacent"
VERDICT_CONFIRMED = "confirmed"
VERDICT_WATCH = "watch"
VERDICT_NONE = "none"
TIER_DATASET = "elliptic-derived"
TIER_SUPPLEMENTARY = "supplementary-source"
TIER_LIVE_UTXO = "live-traced-utxo"
SOURCE_INDEXED = "elliptic-indexed"
SOURCE_LIVE = "live-lookup"
SOURCE_NOT_FOUND = "not-found-on-chain"
SOURCE_BAD_FORMAT = "invalid-address-format"
STEP_SECONDS = 14 * 24 * 3600
SATS_PER_BTC = 100_000_000
BTC_TO_INR = 894_800
N_FEATURES = 166
EXPECTED_TX_COUNT = 203_769
EXPECTED_EDGE_COUNT = 234_355


@dataclass(frozen=True)
class Params:
    hub_degree: int = 50
    train_fraction: float = 0.70
    val_fraction: float = 0.15
    peel_min_hops: int = 2
    peel_max_gap: int = 1
    fanout_min_out: int = 10
    fanout_max_in: int = 1
    fanout_window: int = 1
    mixer_max_hops: int = 2
    hop_depth: int = 2
    weight_peel: int = 40
    weight_fanout: int = 30
    weight_mixer: int = 30
    flag_high: int = 60
    flag_medium: int = 30
    forest_trees: int = 200
    seed: int = 42
    learned_threshold: float = 0.5
    member_sample: int = 10
    tx_cap: int | None = None  # of a live trace; none by default
    fetch_cap: int | None = None
    node_cap: int = 500  # nodes shown of a case
    forest_depth: int = 30  # MLlib's limit: trees grow in full
    address_max_length: int = 128

    def __post_init__(self) -> None:
        if self.hop_depth < 1:
            raise ValueError(f"hop_depth must be at least 1, got {self.hop_depth}")

    @classmethod
    def from_env(cls, **overrides) -> "Params":
        """Defaults with the three rule thresholds open to environment overrides."""
        env = {
            field: int(os.environ[name])
            for field, name in (
                ("peel_min_hops", "FUNDTRAIL_PEEL_MIN_HOPS"),
                ("fanout_min_out", "FUNDTRAIL_FANOUT_MIN_OUT"),
                ("mixer_max_hops", "FUNDTRAIL_MIXER_MAX_HOPS"),
            )
            if name in os.environ
        }
        return cls(**{**env, **overrides})

    def with_(self, **changes) -> "Params":
        return replace(self, **changes)

    def as_dict(self) -> dict:
        return asdict(self)
