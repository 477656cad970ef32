"""MTH1-MTH5, DAT1: numeric column expressions."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    """Columns pass through, strings name columns, numbers become literals."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def exp_decay(horizon, x) -> Column:
    """1 at x=0, falling to 0 as x reaches the horizon; 0 at or beyond it.

    ``when`` is evaluated lazily, so the division never sees x == horizon.
    """
    n, v = _c(horizon).cast("double"), _c(x).cast("double")
    return F.when(v >= n, F.lit(0.0)).otherwise(F.exp(-v / (n - v)))


_EPOCH_NTZ = "1970-01-01 00:00:00"


def epoch_us(ts) -> Column:
    """Microseconds since 1970-01-01 00:00 of a wall-clock TIMESTAMP_NTZ (read as UTC).

    Built from the calendar fields of the wall-clock value, so the session time zone
    never enters: ``unix_micros`` or a cast to TIMESTAMP would go through it.
    """
    t = _c(ts)
    days = F.datediff(F.to_date(t), F.lit(_EPOCH_NTZ[:10]).cast("date")).cast("bigint")
    return (days * F.lit(86_400_000_000) + F.hour(t).cast("bigint") * F.lit(3_600_000_000)
            + F.minute(t).cast("bigint") * F.lit(60_000_000)
            + (F.date_part(F.lit("SECOND"), t) * F.lit(1_000_000)).cast("bigint"))


def floor_div(c, d: int) -> Column:
    """Exact integer floor division of a BIGINT column by a positive constant."""
    c = _c(c)
    return ((c - F.pmod(c, F.lit(d))) / F.lit(d)).cast("bigint")


def hour_index(ts) -> Column:
    return floor_div(epoch_us(ts), 3_600_000_000)


def day_index(ts) -> Column:
    return floor_div(epoch_us(ts), 86_400_000_000)


def ttl_bucket(ts, ttl_seconds: float, start=None) -> Column:
    """Index of the TTL bucket holding ``ts``; a non-positive TTL means 65536 s."""
    ttl = ttl_seconds if ttl_seconds > 0 else 65536
    us = epoch_us(ts)
    if start is not None:
        us = us - epoch_us(start)
    return floor_div(us, int(ttl * 1_000_000))


def block_number(ts, block_seconds: int = 12) -> Column:
    """Chain block index of a timestamp (one block every ``block_seconds``)."""
    return floor_div(epoch_us(ts), block_seconds * 1_000_000)


def minutes_to_seconds(m) -> Column:
    return _c(m).cast("double") * 60.0
