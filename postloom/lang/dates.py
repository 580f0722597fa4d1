"""Dates, durations and sizes of the search language, as milliseconds and bytes; calendar dates are UTC days."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from postloom.lang.query import QueryError

HOUR = 3_600_000
UNITS = {"h": HOUR, "d": 24 * HOUR, "w": 7 * 24 * HOUR, "m": 30 * 24 * HOUR, "mo": 30 * 24 * HOUR, "y": 365 * 24 * HOUR}
_SHAPES = (r"(?P<y>\d{4})", r"(?P<y>\d{4})[-/](?P<m>\d{1,2})", r"(?P<y>\d{4})[-/](?P<m>\d{1,2})[-/](?P<d>\d{1,2})", r"(?P<d>\d{1,2})\.(?P<m>\d{1,2})\.(?P<y>\d{4})")


def _ms(moment: datetime) -> int:
    return int(moment.timestamp() * 1000)


def relative(value: str, now: int) -> int | None:
    """7d, 2w, 1y ... before ``now``."""
    m = re.fullmatch(r"(\d+)\s*(h|d|w|mo|m|y)", value.strip().lower())
    return now - int(m[1]) * UNITS[m[2]] if m else None


def period(value: str, now: int) -> tuple[int, int]:
    """Start and end (exclusive) of the year, month, day or moment that ``value`` names."""
    v = value.strip().lower()
    day = datetime.fromtimestamp(now / 1000, timezone.utc).replace(hour=0, minute=0, second=0, microsecond=0)
    if v in ("today", "heute", "yesterday", "gestern"):
        day -= timedelta(days=v in ("yesterday", "gestern"))
        return _ms(day), _ms(day + timedelta(days=1))
    if (past := relative(v, now)) is not None:
        return past, past + 1
    for shape in _SHAPES:
        if m := re.fullmatch(shape, v):
            parts = {k: int(x) for k, x in m.groupdict().items()}
            try:
                start = datetime(parts["y"], parts.get("m", 1), parts.get("d", 1), tzinfo=timezone.utc)
            except ValueError:
                break
            if "d" in parts:
                end = start + timedelta(days=1)
            elif "m" in parts:
                end = datetime(start.year + start.month // 12, start.month % 12 + 1, 1, tzinfo=timezone.utc)
            else:
                end = datetime(start.year + 1, 1, 1, tzinfo=timezone.utc)
            return _ms(start), _ms(end)
    if re.match(r"\d{4}-\d{2}-\d{2}t", v):
        try:
            moment = datetime.fromisoformat(value.strip().replace("Z", "+00:00"))
        except ValueError:
            moment = None
        if moment is not None:
            start = _ms(moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc))
            return start, start + 1
    raise QueryError(f"{value} is no date, such as 2025, 2025-03, 2025-03-14, 14.03.2025, today or 7d")


def size(value: str) -> int:
    """Bytes of 500, 500K, 2M, 1.5G."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?)\s*([KMG]?)B?", value.strip().upper())
    if not m:
        raise QueryError(f"{value} is no size, such as 500K or 2M")
    return round(float(m[1]) * 1024 ** " KMG".index(m[2] or " "))
