"""Times as text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Z, UTC or GMT, or an offset, after a time of day.
_ZONED = r"[0-9]{1,2}:[0-9]{2}.*([zZ]|UTC|GMT|[+-][0-9]{1,2}(:?[0-9]{2})?)$"


def utc_time(text: Column) -> Column:
    """Text as a time without zone: in UTC if it names a zone, else as it stands. NULL if it is no time.

    The instant is counted from the epoch, so neither the session's zone nor its changes of clocks matter.
    """
    text = F.trim(text)
    micros = F.unix_micros(text.try_cast("timestamp")).cast("decimal(24,6)") / F.lit(1_000_000)
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    since = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), micros.cast("decimal(18,6)"))
    return F.when(text.rlike(_ZONED), epoch + since).otherwise(text.try_cast("timestamp_ntz"))
