"""The period that a command looks back on."""

from __future__ import annotations

from datetime import datetime, timedelta

#: Days of a named period.
PERIODS = {"week": 7, "month": 30, "quarter": 90}


def resolve(days: int | None = None, start: str | None = None, end: str | None = None, period: str | None = None, now: datetime | None = None) -> tuple[datetime, datetime, str]:
    """(start, end, mode); the end is exclusive, and a given end day counts whole. Without a choice, 7 days."""
    now = now or datetime.now()
    if sum(x is not None for x in (days, start, period)) > 1:
        raise ValueError("give only one of days, a date range and a period")
    if start or end:
        if not start:
            raise ValueError("a date range needs its start")
        try:
            first = datetime.fromisoformat(start)
            beyond = datetime.fromisoformat(end) + timedelta(days=1) if end else now
        except ValueError as e:
            raise ValueError(f"dates are YYYY-MM-DD: {e}") from e
        if first > beyond:
            raise ValueError("the start lies after the end")
        return first, beyond, "date_range"
    if period is not None:
        if period not in PERIODS:
            raise ValueError(f"period not known: {period}")
        return now - timedelta(days=PERIODS[period]), now, period
    days = 7 if days is None else days
    if days <= 0:
        raise ValueError("days must be over 0")
    return now - timedelta(days=days), now, "days"


def label(start: datetime, end: datetime) -> tuple[str, str]:
    """First and last day as text."""
    return start.strftime("%Y-%m-%d"), (end - timedelta(seconds=1)).strftime("%Y-%m-%d")
