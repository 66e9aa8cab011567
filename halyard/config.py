"""Settings of the forecasting engine; every operator takes them as one frozen value."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Fixed values unless a caller says otherwise."""

    recent_daily: int = 252
    recent_monthly: int = 36
    block_daily: int = 7
    block_monthly: int = 3
    halflife_daily: int = 20
    halflife_monthly: int = 6
    tau_daily: float = 60.0
    tau_monthly: float = 6.0
    w_recent: float = 0.6
    min_joint_rows: int = 60
    min_pool_rows: int = 30
    z_floor: float = 0.25
    peg_trigger: float = 0.25
    peg_floor: float = 0.5
    lag_days: int = 45
    stress_daily: int = 21
    stress_monthly: int = 6
    stress_percentile: float = 0.85
    p_stress: float = 0.12
    vol_uncertainty: float = 0.25
    width: float = 1.0
    cumlog_drift: float = 0.0
    vol0_floor: float = 1.5
    max_docs: int = 16
    max_doc_chars: int = 9000
    max_scenarios: int = 4
    drift_clamp: float = 0.75
    vol_low: float = 0.6
    vol_high: float = 3.0
    drift_shrink: float = 0.7
    vol_shrink: float = 0.5
    floor_scale: float = 0.0
    min_drift: float = 0.20
    min_agreeing: int = 3
    min_share: float = 0.25
    max_width: float = 1.6
    event_strict: bool = True
    tail_enabled: bool = False
    stress_enabled: bool = False
    fallback_knobs: bool = True
    seed: int = 0


DEFAULT = Config()
