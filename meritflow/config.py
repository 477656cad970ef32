"""Parameters with the defaults of the modelled system."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ScoringConfig:
    alpha: float = 0.1                 # EMA weight of a new observation
    eval_mult: float = 9.0             # reward = eval_mult * eval + time_mult * decay
    time_mult: float = 1.0
    timeout_secs: float = 30 * 60.0    # task deadline; also the decay horizon


@dataclass(frozen=True)
class WeightConfig:
    max_weight_limit: float = 0.1
    min_allowed_weights: int = 10
    exclude_quantile: int = 0          # in u16 units, as on chain
    epsilon: float = 1e-7
    u16_max: int = 65535


@dataclass(frozen=True)
class PopulationConfig:
    vpermit_tao_limit: float = 4096.0
    allow_non_registered: bool = False
    force_validator_permit: bool = False
    top_stake_fraction: float = 0.1
    max_api_nodes: int = 3
    epoch_length: int = 100            # blocks
    block_seconds: int = 12


@dataclass(frozen=True)
class IngestConfig:
    min_files: int = 3                 # files per directory (validator default)
    min_len: int = 50                  # characters, strict >


@dataclass(frozen=True)
class RatingConfig:
    elo_k: float = 32.0
    elo_default: float = 1200.0
    elo_rounds: int = 2
    draw_mode: str = "reference"       # "reference" | "standard"
    ts_mu: float = 25.0
    ts_sigma: float = 25.0 / 3
    ts_beta: float = 25.0 / 6
    ts_tau: float = 25.0 / 300
    ts_draw_probability: float = 0.10
    ts_passes: int = 3
