"""Event-time window finalization and metering analytics on PySpark."""

from finality.config import Policy, WindowSpec, parse_duration

__all__ = ["Policy", "WindowSpec", "parse_duration"]
