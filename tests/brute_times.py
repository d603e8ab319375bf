"""A plain reading of one time at a time with Python's own calendar and zones, to hold the operator against."""

from __future__ import annotations

import re
from datetime import UTC, date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo, available_timezones

from panewright.operators.timestamps import ABBREVIATIONS, MONTHS

_ZONES = available_timezones()
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def read_date(text: str | None) -> date | None:
    t = (text or "").strip(" ")
    month = lambda x: next((i for i, m in enumerate(MONTHS, 1) if x.lower() in (m, m[:3])), 0)
    for pattern, build in (
        (r"(\d{4})-(\d\d?)-(\d\d?)", lambda a, b, c: (int(a), int(b), int(c))),
        (r"(\d{4})(\d\d)(\d\d)", lambda a, b, c: (int(a), int(b), int(c))),
        (r"(\d\d?)/(\d\d?)/(\d{4}|\d\d)", lambda a, b, c: (int(c) + 2000 * (len(c) == 2), int(a), int(b))),
        (r"(\d\d?)\.(\d\d?)\.(\d{4}|\d\d)", lambda a, b, c: (int(c) + 2000 * (len(c) == 2), int(b), int(a))),
        (r"(?:[A-Za-z]+, )?(\d\d?)[ -]([A-Za-z]{3,9})[ -](\d{4})", lambda a, b, c: (int(c), month(b), int(a))),
        (r"(?:[A-Za-z]+, )?([A-Za-z]{3,9}) (\d\d?),? (\d{4})", lambda a, b, c: (int(c), month(a), int(b))),
    ):
        if m := re.fullmatch(pattern, t, re.ASCII):
            try:
                return date(*build(*m.groups()))
            except ValueError:
                return None
    return None


def read(value: str | None, day_text: str | None, zone_name: str | None) -> str | None:
    """The moment's text, gap, overlap, or None."""
    v = (value or "").strip(" ")
    if re.fullmatch(r"\d{10}|\d{13}|\d{16}", v, re.ASCII):
        return _say(_EPOCH + timedelta(microseconds=int(v.ljust(16, "0"))))
    zone: object = zone_name
    if m := re.search(r" ?\[([A-Za-z_]+(?:/[A-Za-z_]+)+)\]$| ([A-Za-z_]+(?:/[A-Za-z_]+)+)$", v):
        zone, v = m[1] or m[2], v[: m.start()]
        if zone not in _ZONES:
            return None
    elif m := re.search(r"(?<=[0-9 Mm])([+-])(\d\d):?(\d\d)$", v):
        if int(m[2]) > 18 or int(m[3]) > 59:
            return None
        zone, v = timezone((1 if m[1] == "+" else -1) * timedelta(hours=int(m[2]), minutes=int(m[3]))), v[: m.start()].rstrip(" ")
    elif (m := re.search(r"(Z| [A-Z]{2,4})$", v)) and m[1].strip() in ABBREVIATIONS:
        zone, v = timezone(timedelta(seconds=ABBREVIATIONS[m[1].strip()])), v[: m.start()]
    day = None
    if m := re.fullmatch(r"\d{1,4}", v, re.ASCII):
        digits = v.zfill(4)
        h, mi, s, f, half, day_of = digits[:2], digits[2:], "0", "", "", day_text
    elif m := re.fullmatch(r"(\d{8})T?(\d\d)(\d\d)(\d\d)", v, re.ASCII):
        day_of, h, mi, s, f, half = *m.groups(), "", ""
    elif m := re.fullmatch(r"(?:(.+?)(?:T| +))?(\d\d?)[:h](\d\d)(?::(\d\d)(?:\.(\d+))?)?(?: ?([AaPp])[Mm])?", v, re.ASCII):
        day_of, h, mi, s, f, half = m.groups(default="")
        day_of = day_of or day_text
    else:
        return None
    day, hour, minute, second = read_date(day_of), int(h), int(mi), int(s or 0)
    if half:
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + 12 * (half.lower() == "p")
    if day is None or minute > 59 or second > 59 or hour > 24 or hour == 24 and (minute or second):
        return None
    wall = datetime(day.year, day.month, day.day) + timedelta(hours=hour, minutes=minute, seconds=second, microseconds=int(f[:6].ljust(6, "0")))
    if zone is None:
        return None
    if isinstance(zone, timezone):
        return _say(wall.replace(tzinfo=zone))
    place = ZoneInfo(zone)
    held = {u for u in (wall.replace(tzinfo=place, fold=k).astimezone(UTC) for k in (0, 1)) if u.astimezone(place).replace(tzinfo=None) == wall}
    return "gap" if not held else "overlap" if len(held) > 1 else _say(held.pop())


def _say(t: datetime) -> str:
    return t.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
