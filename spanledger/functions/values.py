"""Measures, identifiers and clocks. Invalid or missing input becomes NULL, never 0."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NANO = 1_000_000_000
DAY_MS = 86_400_000
MAX_SAFE_INTEGER = 2**53 - 1
MAX_TEXT = 512


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it many times: body(value). Keeps generated code small."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def nonnegative(value: Column) -> Column:
    """A finite double >= 0, else NULL (NaN sorts above infinity, so it fails too)."""
    d = value.cast("double")
    return F.when((d >= 0) & (d < F.lit(float("inf"))), d)


def token_count(value: Column) -> Column:
    """A safe non-negative integer, else NULL; a fraction is not a count."""
    d = nonnegative(value)
    return F.when((d == F.floor(d)) & (d <= MAX_SAFE_INTEGER), d).cast("bigint")


def reported_nano(value: Column) -> Column:
    """Nano credits from text or number: blank, non-numeric and negative are unreported."""
    return token_count(value.cast("string").try_cast("double"))


def span_failed(status: Column) -> Column:
    """Status 1 is success, 2 is failure, everything else is unknown."""
    code = F.trim(status.cast("string")).try_cast("double")
    return F.when(code == 1, F.lit(False)).when(code == 2, F.lit(True))


def short_text(value: Column) -> Column:
    """A non-empty string of at most 512 characters, else NULL."""
    return F.when(F.length(value).between(1, MAX_TEXT), value)


def hr_to_ms(hr: Column) -> Column:
    """[seconds, nanos] to epoch milliseconds; anything else is 0, meaning "no time"."""
    sec, ns = hr.getItem(0), hr.getItem(1)
    ms = sec.cast("double") * 1000 + ns.cast("double") / 1e6
    return F.when((F.size(hr) >= 2) & (F.abs(ms) < F.lit(float("inf"))), ms).otherwise(F.lit(0.0))


def round_half_up(value: Column) -> Column:
    return F.floor(value + 0.5).cast("bigint")


def credit_sum(nano: Column) -> Column:
    """Sum whole nano credits exactly, divide once. NULL when nothing was reported."""
    return F.sum(nano.cast("decimal(20,0)")).cast("double") / F.lit(float(NANO))


def utc_day(ms: Column) -> Column:
    """ISO day of an epoch-ms value, independent of the session time zone."""
    return F.date_from_unix_date(F.floor(ms / DAY_MS).cast("int")).cast("string")


def month_start_ms(now_ms: int) -> int:
    from datetime import datetime, timezone

    now = datetime.fromtimestamp(now_ms / 1000, timezone.utc)
    return int(now.replace(day=1, hour=0, minute=0, second=0, microsecond=0).timestamp() * 1000)
