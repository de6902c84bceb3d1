"""Scalar functions of the console and the gateway."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB")
TENANT_ID = "^[a-z0-9][a-z0-9_-]{0,62}$"


def format_bytes(size: Column, units: tuple[str, ...] = UNITS, digits: int | None = None) -> Column:
    """Decimal units with three digits or so, or so many decimals; nothing and less is ``0 B``."""
    out = F.concat(F.format_string("%.0f", size.cast("double")), F.lit(" B"))
    for i, unit in enumerate(units[1:], 1):
        v = size / 1000.0**i
        if digits is None:
            shown = F.when(v >= 100, F.format_string("%.0f", v)).when(v >= 10, F.format_string("%.1f", v)).otherwise(F.format_string("%.2f", v))
        else:
            shown = F.format_string(f"%.{digits}f", v)
        out = F.when(v >= 1, F.concat(shown, F.lit(f" {unit}"))).otherwise(out)
    return F.when(size <= 0, "0 B").otherwise(out)


def namespaced(tenant: Column, key: Column) -> Column:
    return F.concat(F.lit("t:"), tenant, F.lit(":"), key)


def tenant_of(key: Column) -> Column:
    """The tenant of a namespaced key, else null."""
    return F.when(key.rlike("^t:[^:]+:"), F.split(key, ":", 3)[1])


def is_tenant_id(text: Column) -> Column:
    return text.rlike(TENANT_ID)


def share(part: Column, whole: Column) -> Column:
    """Percent, null for nothing of nothing."""
    return 100.0 * part / F.nullif(whole, F.lit(0))


def normal_email(text: Column) -> Column:
    """Trimmed and lower-cased; null if that is no plain address of at most 254 characters."""
    email = F.lower(F.trim(text))
    return F.when((F.length(email) <= 254) & email.rlike(r"^[a-z0-9!#$%&'*+/=?^_`{|}~-]+(\.[a-z0-9!#$%&'*+/=?^_`{|}~-]+)*@[a-z0-9.-]+$"), email)


def is_key_prefix(text: Column, start: str = "key_live_") -> Column:
    """A fixed start and eight hexadecimal digits."""
    return text.rlike(f"^{start}[0-9a-f]{{8}}$")


def rfc3339(seconds: Column) -> Column:
    """Seconds since the epoch as UTC time in RFC 3339, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
