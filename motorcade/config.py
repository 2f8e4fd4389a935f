"""Thresholds and prices; every operator takes them as an argument with these defaults."""

from dataclasses import dataclass


@dataclass(frozen=True)
class TripConfig:
    moving_kmh: float = 5.0
    stopped_kmh: float = 1.0
    anchor_m: float = 30.0
    start_m: float = 50.0
    confirm_s: int = 10
    stationary_s: int = 300
    gap_ms: int = 15 * 60 * 1000
    litres_per_km: float = 0.08
    fuel_price: float = 1.45
    co2_per_litre: float = 2.31


@dataclass(frozen=True)
class IdleConfig:
    speed_kmh: float = 2.0
    min_s: int = 120
    allowed_min: float = 10.0
    litres_per_hour: float = 1.5
    fuel_price: float = 1.45
    co2_per_litre: float = 2.31


@dataclass(frozen=True)
class ChargeConfig:
    min_kw: float = 0.05
    default_kw: float = 7.2
    max_gap_ms: int = 300_000
    min_ms: int = 30_000
    price: float = 0.22
    off_peak_price: float = 0.12
    efficiency: float = 0.92
    nominal_kwh: float = 60.0
    soh_min_delta: float = 15.0
    default_soh: float = 95.0
    low_soc: float = 15.0
    critical_soc: float = 8.0
    least_kwh: float = 4.0
    cooldown_ms: int = 300_000


@dataclass(frozen=True)
class SafetyConfig:
    brake_ms2: float = -3.5
    accel_ms2: float = 3.0
    turn_deg_s: float = 30.0
    corner_kmh: float = 30.0
    limit_kmh: float = 100.0
    over_kmh: float = 15.0
    min_dt_ms: int = 200
    max_dt_ms: int = 5000
    cooldown_ms: int = 5000


@dataclass(frozen=True)
class FenceConfig:
    confirm: int = 2
    tow_m: float = 300.0
    tow_window_ms: int = 60_000
    tow_cooldown_ms: int = 300_000


@dataclass(frozen=True)
class ReorderConfig:
    lateness_ms: int = 10_000
    capacity: int = 256
    skew_ms: int = 300_000
    silent_ms: int = 10_000


@dataclass(frozen=True)
class ScoreConfig:
    half_life_days: float = 14.0
    r0: float = 8.0
    min_km: float = 10.0
    risky: float = 60.0


TRIP, IDLE, CHARGE, SAFETY, FENCE, REORDER, SCORE = TripConfig(), IdleConfig(), ChargeConfig(), SafetyConfig(), FenceConfig(), ReorderConfig(), ScoreConfig()
#: Fixed values of the quality bitmask.
GPS_SUSPECT, LATE, IMPUTED, VIN_WARN, CLOCK_SKEW = 1, 2, 4, 8, 16
