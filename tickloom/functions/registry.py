"""Names of metric columns: windows, tags, families, and what follows from them."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Bar minutes to which a window of so many minutes is resampled (fixed values).
RESAMPLE_MINUTES = {60: 1, 240: 3, 720: 10, 1440: 20, 4320: 60, 360: 5, 10080: 120}
#: Percentiles that a baseline keeps (fixed values).
KNOTS = (1, 5, 10, 20, 25, 40, 50, 60, 75, 80, 90, 95, 99)
#: Name prefixes of metrics that percentile ranks compare in log1p or signed-log space (fixed values).
POSITIVE = ("atr_", "bollinger_width_", "volume_sum_", "quote_volume_sum_", "range_intensity_", "rv_close_", "parkinson_vol_", "garman_klass_", "yang_zhang_", "vwap_deviation_abs_", "dist_to_window_high_abs_", "dist_to_window_low_abs_")
SIGNED = ("macd_histogram_", "roc_", "price_deviation_vwap_", "dist_to_window_high_", "dist_to_window_low_", "obv_")
#: Prefixes of columns that carry no signal (fixed values).
HYGIENE = ("timestamp_asof", "window_", "metrics_valid_", "sma_", "ema_fast_", "ema_slow_")
_WINDOW = re.compile(r"_(\d+(?:h|d|m|min))(?:_|$)")


def window_minutes(label: str) -> int:
    """Minutes of a label such as 1h, 90m, 90min, 7d or 90; ValueError for anything else."""
    m = re.fullmatch(r"\s*(\d+)\s*(h|m|min|d)?\s*", label.lower())
    if not m:
        raise ValueError(f"not a window: {label!r}")
    return int(m[1]) * {"h": 60, "d": 1440}.get(m[2] or "", 1)


def is_signal(column: str) -> bool:
    """Whether a column is compared with a baseline."""
    return not (column.startswith(HYGIENE) or column.startswith("macd_") and not column.startswith("macd_histogram_"))


def transform_kind(column: str) -> str:
    """positive, signed or plain. The prefixes are tested on the name without its last part, so an
    untagged name such as atr_1h is plain."""
    base = column.rsplit("_", 1)[0]
    return "positive" if base.startswith(POSITIVE) else "signed" if base.startswith(SIGNED) else "plain"


@dataclass(frozen=True)
class Neutral:
    """What a missing value becomes: a constant, or with ``median`` the row's own p50 if it has one."""

    value: float
    median: bool = False


def neutral_value(column: str, profile: str = "core") -> Neutral | None:
    """None for columns that are not imputed. Profiles: core, state, regime."""
    hygiene = ("timestamp", "window_coverage_", "window_ok_", "window_start", "window_end") + (() if profile == "regime" else ("metrics_valid_",))
    if column == "symbol" or column.startswith(hygiene):
        return None
    for end, value in (("_pctile", 50.0), ("_quintile", 3.0), ("_rz", 0.0), ("_pos", 0.5)):
        if column.endswith(end):
            return Neutral(value)
    ratio = [("_over_" in column, 1.0), ("_minus_" in column, 0.0)]
    signed = [(column.endswith("_dir"), 0.0)]
    for holds, value in (signed + ratio if profile == "core" else ratio + signed):
        if holds:
            return Neutral(value)
    if profile != "regime" and (column.endswith("_mag") or profile == "core" and column.startswith("dist_")):
        return Neutral(0.0, median=True)
    return Neutral(0.0)


def describe_column(column: str) -> dict[str, str | None]:
    """Family, window and tag that a column's name states."""
    m = _WINDOW.search(column)
    tag = next((t for t in ("mag", "pos", "dir") if re.search(rf"_{t}(_|$)", column)), None)
    family = "hygiene" if column.startswith(HYGIENE[:3]) else column[: m.start()] if m else column
    return {"family": family, "window": m[1] if m else None, "tag": tag}
