"""Policies, window parameters and job arguments."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Names that occur in the data and in the result files.
SERIES_L1 = "Spänning L1"
SERIES_L2 = "Spänning L2"
SERIES_L3 = "Spänning L3"
VOLTAGE_SERIES = (SERIES_L1, SERIES_L2, SERIES_L3)
THREE_PHASE_LABEL = "Spänning L1/L2/L3"
SINGLE, THREE = "SINGLE", "THREE"

FAST, DELAYED, BASELINE, PROPOSED = "fast", "delayed", "baseline", "proposed"
MODES = (FAST, DELAYED, BASELINE, PROPOSED)
SOURCES = ("kafka", "gzip")

_UNIT_MS = {"m": 60_000, "h": 3_600_000, "d": 86_400_000}


def parse_duration(text: str) -> int:
    """``0``, ``Nm``, ``Nh`` or ``Nd`` to milliseconds."""
    if text == "0":
        return 0
    match = re.fullmatch(r"([+-]?\d+)([mhd])", text)
    if match is None:
        raise ValueError(f"Unsupported duration (use 0, Nh, Nm or Nd): {text!r}")
    return int(match[1]) * _UNIT_MS[match[2]]


@dataclass(frozen=True)
class WindowSpec:
    """Tumbling window, expected readings and fault rule.

    ``expected`` counts readings of one series in one window; three-phase
    meters expect three times as many. ``block_bits`` sets how many arrivals
    make one block of the arrival-order scan (2**block_bits).
    """

    size_ms: int = 7_200_000
    expected: int = 8
    threshold: float = 0.75
    zero_tolerance: float = 0.001
    zero_run: int = 3
    zone: str = "UTC"
    block_bits: int = 16

    @property
    def slot_ms(self) -> int:
        return self.size_ms // self.expected

    def expected_for(self, phase_group: str) -> int:
        return self.expected * (3 if phase_group == THREE else 1)

    def preliminary_for(self, phase_group: str) -> int | None:
        """Smallest count whose ratio reaches the threshold, if before full."""
        full = self.expected_for(phase_group)
        return next((n for n in range(1, full) if n / full >= self.threshold), None)


@dataclass(frozen=True)
class Policy:
    """When a window's answer counts as final.

    ``delay_ms`` is how far the watermark trails the largest event time,
    ``lateness_ms`` how long a closed window still takes late readings.
    """

    mode: str
    delay_ms: int = 0
    lateness_ms: int = 0

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"Unsupported mode: {self.mode!r}; expected one of {MODES}")

    @classmethod
    def of(cls, mode: str, time_setting: str | int = "50h") -> "Policy":
        """The policy a mode and its time setting stand for."""
        mode = mode.strip().lower()
        ms = time_setting if isinstance(time_setting, int) else parse_duration(time_setting)
        if mode == FAST:
            return cls(mode)
        if mode == DELAYED:
            return cls(mode, delay_ms=ms)
        return cls(mode, lateness_ms=ms)

    @property
    def label(self) -> str:
        return self.mode.upper()

    @property
    def completes_early(self) -> bool:
        return self.mode == PROPOSED


@dataclass(frozen=True)
class JobArgs:
    """Checked arguments of the window job.

    ``kafka`` reads a topic from ``servers``, or from ``topic_folder`` where it is kept as
    segments, see ``finality.sources.segments``.
    """

    run_id: str = "default_run"
    mode: str = PROPOSED
    time_setting: str = "50h"
    source: str = "kafka"
    path_glob: str = "/data/RawData/raw_meter_data.log-*.gz"
    from_date: str | None = None
    to_date: str | None = None
    out_dir: str = "output/results"
    topic: str = "cm_meter_values"
    servers: str = "localhost:9092"
    group_id: str = "finality"
    topic_folder: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "mode", self.mode.strip().lower())
        object.__setattr__(self, "source", self.source.strip().lower())
        object.__setattr__(self, "time_setting", self.time_setting.strip())
        if self.source not in SOURCES:
            raise ValueError(f"Unsupported source: {self.source!r}; expected one of {SOURCES}")
        for name in ("from_date", "to_date"):
            text = getattr(self, name)
            if text is not None:
                object.__setattr__(self, name, check_date(text, name))
        self.policy  # rejects an unknown mode or duration

    @property
    def policy(self) -> Policy:
        return Policy.of(self.mode, self.time_setting)


def check_date(text: str, name: str) -> str:
    text = text.strip()
    if not re.fullmatch(r"\d{8}", text, re.ASCII):
        raise ValueError(f"{name} must be 8 digits (YYYYMMDD), got: {text!r}")
    return text
