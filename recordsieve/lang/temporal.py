"""Date and datetime literals: parsing, ordering, equality and formatting to the nanosecond."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

_ISO = re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})(?:T([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\.([0-9]+))?(Z|[+-][0-9]{2}:[0-9]{2})?)?\Z")
_EPOCH = date(1970, 1, 1).toordinal()
_BLANK = " \t\n\v\f\r"
#: Longer strings are never read as times.
MAX_TEXT = 8192


@dataclass(frozen=True)
class Temporal:
    seconds: int
    nanos: int
    day: tuple[int, int, int]
    date_only: bool

    @property
    def instant(self) -> tuple[int, int]:
        return self.seconds, self.nanos


def _days(y: int, m: int, d: int) -> int | None:
    try:
        # year 0 is a leap year like 400; date() starts at 1
        return date(y, m, d).toordinal() - _EPOCH if y else date(400, m, d).toordinal() - 146097 - _EPOCH
    except ValueError:
        return None


def parse(text: str, strict: bool = False) -> Temporal | None:
    """The time a text spells, or None. ``strict`` wants a datetime with a zone and no blanks around it."""
    if len(text) >= MAX_TEXT:
        return None
    found = _ISO.match(text if strict else text.strip(_BLANK))
    if not found:
        return None
    y, m, d = (int(x) for x in found.groups()[:3])
    days = _days(y, m, d)
    if days is None:
        return None
    if found[4] is None:
        return None if strict else Temporal(days * 86400, 0, (y, m, d), True)
    hour, minute, second = (int(x) for x in found.groups()[3:6])
    zone = found[8]
    if hour > 23 or minute > 59 or second > 59 or (strict and zone is None):
        return None
    offset = 0
    if zone and zone != "Z":
        if int(zone[1:3]) > 23 or int(zone[4:]) > 59:
            return None
        offset = (int(zone[1:3]) * 3600 + int(zone[4:]) * 60) * (-1 if zone[0] == "-" else 1)
    nanos = int((found[7] or "")[:9].ljust(9, "0"))
    return Temporal(days * 86400 + hour * 3600 + minute * 60 + second - offset, nanos, (y, m, d), False)


def equal(a: Temporal, b: Temporal) -> bool:
    """By the day as written if either is a bare date, else by instant."""
    return a.day == b.day if a.date_only or b.date_only else a.instant == b.instant


def civil(seconds: int) -> tuple[int, int, int, int, int, int]:
    """Year, month, day, hour, minute and second in UTC of any time, years before 1 and after 9999 included."""
    days, rest = divmod(seconds, 86400)
    cycles = (days + _EPOCH - 1) // 146097  # of 400 years
    at = date.fromordinal(days + _EPOCH - cycles * 146097)
    return at.year + 400 * cycles, at.month, at.day, rest // 3600, rest // 60 % 60, rest % 60


def utc_text(t: Temporal) -> str:
    """RFC 3339 in UTC, the fraction without trailing zeros."""
    year, *rest = civil(t.seconds)
    fraction = f".{t.nanos:09d}".rstrip("0") if t.nanos else ""
    return "{:04d}-{:02d}-{:02d}T{:02d}:{:02d}:{:02d}".format(year, *rest) + fraction + "Z"


def of_datetime(at: datetime) -> Temporal:
    at = at.replace(tzinfo=timezone.utc) if at.tzinfo is None else at.astimezone(timezone.utc)
    return Temporal(int((at.replace(microsecond=0) - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds()), at.microsecond * 1000, (at.year, at.month, at.day), False)


def since(word: str, now: datetime) -> Temporal:
    """The inclusive lower bound that now, today or yesterday names at ``now``."""
    t = of_datetime(now)
    if word == "now":
        return t
    start = t.seconds // 86400 * 86400 - (86400 if word == "yesterday" else 0)
    at = datetime(1970, 1, 1) + timedelta(seconds=start)
    return Temporal(start, 0, (at.year, at.month, at.day), False)
