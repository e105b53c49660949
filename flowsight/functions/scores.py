"""Feature formulas of single flows. Every divisor that can be 0 goes through ``try_divide``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parsing import as_column

# --- fixed values -----------------------------------------------------------
AUTH_FAILURE_CODES = (401, 403, 429)
RISKY_CODES = (401, 403, 429, 500, 503)
EPSILON = 1e-9
# ----------------------------------------------------------------------------


def _code_in(status: Column | str, codes: Sequence[int]) -> Column:
    return F.coalesce(as_column(status).isin(*[float(c) for c in codes]), F.lit(False))


def auth_failure(status: Column | str = "status_code") -> Column:
    return _code_in(status, AUTH_FAILURE_CODES)


def risky_status(status: Column | str = "status_code") -> Column:
    return _code_in(status, RISKY_CODES)


def indicator(condition: Column) -> Column:
    """1.0 where the condition holds, else 0.0."""
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), value))


def failed_logins_derived(failed: Column | str = "failed_logins", status: Column | str = "status_code") -> Column:
    """The recorded failures when positive, else one failure for a rejected request."""
    recorded = as_column(failed)
    return F.when(recorded > 0, recorded).otherwise(indicator(auth_failure(status)))


def total_attempts_derived(total: Column | str = "total_attempts", logins: Column | str = "login_attempts") -> Column:
    recorded = as_column(total)
    return F.when(recorded > 0, recorded).otherwise(as_column(logins) + 1.0)


def connection_rate(rate: Column | str = "request_rate", duration: Column | str = "connection_duration") -> Column:
    return F.try_divide(as_column(rate), as_column(duration) + 1.0)


def failed_login_ratio(failed: Column, attempts: Column) -> Column:
    return F.try_divide(failed, attempts + EPSILON)


def stream_failed_login_ratio(status: Column | str = "status_code", logins: Column | str = "login_attempts") -> Column:
    return F.try_divide(indicator(auth_failure(status)), as_column(logins) + 1.0)


def traffic_spike_score(rate: Column | str, mean: Column | str, deviation: Column | str) -> Column:
    """Distance from the source's own mean rate, in damped deviations."""
    return F.try_divide(F.abs(as_column(rate) - as_column(mean)), as_column(deviation) + 1.0)


def packet_entropy(size: Column | str = "packet_size", volume: Column | str = "bytes_transferred") -> Column:
    share = F.try_divide(as_column(size), as_column(volume) + 1.0)
    return -share * F.log2(share + EPSILON)


def safe_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Division that takes a divisor of 0 or less as 1."""
    below = as_column(denominator)
    return as_column(numerator) / F.when(below <= 0, F.lit(1.0)).otherwise(below)


def standard_score(value: Column | str, mean: Column, deviation: Column) -> Column:
    """Signed z-score; a deviation of 0 counts as 1."""
    return (as_column(value) - mean) / F.when(deviation == 0, F.lit(1.0)).otherwise(deviation)
