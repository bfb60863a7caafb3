"""Times as report text, and conversions between the two epoch units of the wire.

Texts are in the session time zone, which is UTC throughout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Report formats.
DATETIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
HHMM_FORMAT = "HH:mm"
RFC3339_FORMAT = "yyyy-MM-dd'T'HH:mm:ssXXX"


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fmt_uptime(seconds: str | Column) -> Column:
    """``3d 4h 5m``: days and hours only where not zero, minutes always."""
    total = _column(seconds).cast("bigint")
    days = F.floor(total / 86400)
    hours = F.floor(F.pmod(total, F.lit(86400)) / 3600)
    minutes = F.floor(F.pmod(total, F.lit(3600)) / 60)
    text = F.concat_ws(
        " ",
        F.when(days > 0, F.concat(days.cast("string"), F.lit("d"))),
        F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h"))),
        F.concat(minutes.cast("string"), F.lit("m")),
    )
    return F.when(total.isNotNull(), text)


def fmt_datetime(at: str | Column) -> Column:
    """Date and time of a timestamp or timestamp text; ``-`` where missing or not a time."""
    return F.coalesce(F.date_format(F.try_to_timestamp(_column(at)), DATETIME_FORMAT), F.lit("-"))


def fmt_hhmm(epoch_seconds: str | Column) -> Column:
    return F.date_format(s_to_ts(epoch_seconds), HHMM_FORMAT)


def rfc3339(epoch_seconds: str | Column) -> Column:
    return F.date_format(s_to_ts(epoch_seconds), RFC3339_FORMAT)


def s_to_ts(epoch_seconds: str | Column) -> Column:
    return F.timestamp_seconds(_column(epoch_seconds))


def ms_to_ts(epoch_millis: str | Column) -> Column:
    return F.timestamp_millis(_column(epoch_millis))


def ts_to_s(at: str | Column) -> Column:
    return F.unix_seconds(_column(at).cast("timestamp"))


def ts_to_ms(at: str | Column) -> Column:
    return F.unix_millis(_column(at).cast("timestamp"))


def ms_to_s(epoch_millis: str | Column) -> Column:
    """Milliseconds to whole seconds, rounded down."""
    return F.unix_seconds(ms_to_ts(epoch_millis))


def s_to_ms(epoch_seconds: str | Column) -> Column:
    return _column(epoch_seconds).cast("bigint") * F.lit(1000)
