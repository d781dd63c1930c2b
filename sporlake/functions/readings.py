"""All valid readings of a timestamp text."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta
from zoneinfo import available_timezones

_MONTHS = {
    m[:n] if n else m: k
    for names in (
        "january february march april may june july august september october november december",
        "januar februar mars april mai juni juli august september oktober november desember",
        "januari februari mars april maj juni juli augusti september oktober november december",
    )
    for k, m in enumerate(names.split(), 1)
    for n in (0, 3, 4)
}
#: Offsets of zone abbreviations in minutes (fixed values).
ABBREVIATIONS = {"z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "met": 60, "mest": 120, "eet": 120, "eest": 180, "msk": 180, "ist": 330, "jst": 540, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420}
_ZONES = {z.lower(): z for z in available_timezones() if "/" in z or z in ("UTC", "GMT")}

_ZONE = r"(?: ?(?P<zone>[+-]\d\d(?::?\d\d)?|[a-z]{1,4}|[a-z_]+(?:/[a-z_+-]+)+)(?:\[[a-z_/+-]+\])?)?"
_CLOCK = r"(?:kl\.? |at )?(?P<h>\d\d?)[:.](?P<mi>\d\d)(?:[:.](?P<s>\d\d)(?:[.,](?P<f>\d+))?)?(?: ?(?P<ap>am|pm)(?![a-z]))?" + _ZONE
_TIME = rf"(?:[ t,]+{_CLOCK})?$"
_DAY = r"(?:[a-zæøåäö]+\.?,? )?"
_WORD = r"(?P<m>[a-zæøåäö]+)\.?"
_RE = [
    re.compile(x)
    for x in (
        r"(?P<y>\d{4})-(?P<m>\d\d)-(?P<d>\d\d)" + _TIME,
        r"(?P<y>\d{4})/(?P<m>\d\d)/(?P<d>\d\d)" + _TIME,
        r"(?P<y>\d{4})(?P<m>\d\d)(?P<d>\d\d)$",
        r"(?P<y>\d{4})-?(?P<m>\d\d)-?(?P<d>\d\d)[ t]?(?P<h>\d\d)(?P<mi>\d\d)(?P<s>\d\d)?(?:[.,](?P<f>\d+))?" + _ZONE + "$",
        _DAY + r"(?P<d>\d{1,2})\.?[ -]" + _WORD + r",?[ -](?P<y>\d{4})" + _TIME,
        r"(?:[a-z]+\.?,? )?" + _WORD + r" (?P<d>\d{1,2})(?:st|nd|rd|th)?,? (?P<y>\d{4})" + _TIME,
        r"(?:[a-z]{3} )?" + _WORD + r" (?P<d>\d{1,2}) (?P<h>\d\d):(?P<mi>\d\d):(?P<s>\d\d)(?: (?P<zone>[a-z]{2,4}))? (?P<y>\d{4})$",
        r"(?P<h>\d{1,2})[:.](?P<mi>\d\d)(?::(?P<s>\d\d))?(?: ?(?P<ap>am|pm)(?![a-z]))?,? (?:on )?(?P<d>\d{1,2})\.? " + _WORD + r",? (?P<y>\d{4})$",
    )
]
_WEEK = re.compile(r"(\d{4})-?w(\d\d)-?(\d)" + _TIME)
_ORDINAL = re.compile(r"(\d{4})-(\d{3})" + _TIME)
_EPOCH = re.compile(r"(\d{9,10}|\d{13}|\d{16}|\d{19})(?:[.,](\d+))?$")
_NUMERIC = re.compile(r"(?P<a>\d{1,2})(?P<sep>[./-])(?P<b>\d{1,2})(?P=sep)(?P<c>\d{4}|\d\d)" + _TIME)

#: Positions of the readings of a numeric date.
ORDERS = ("dmy", "mdy", "ymd")
Reading = tuple[str, list[int | None], str | None]
_MS = {9: 10**6, 10: 10**6, 13: 10**3, 16: 1}


def _micros(y: int, m: int, d: int, g: dict) -> int | None:
    """Local microseconds since 1970; offset, half of the day and finer digits are dealt with."""
    h, mi, s = (int(g.get(k) or 0) for k in ("h", "mi", "s"))
    if g.get("ap"):
        if not 1 <= h <= 12:
            return None
        h = h % 12 + 12 * (g["ap"] == "pm")
    if not (h < 24 and mi < 60 and s < 60):
        return None
    try:
        days = date(y, m, d).toordinal() - 719163
    except ValueError:
        return None
    return (days * 86400 + h * 3600 + mi * 60 + s) * 10**6 + int((g.get("f") or "0")[:6].ljust(6, "0"))


def _zone(g: dict) -> tuple[int | None, str | None] | None:
    """(offset in minutes, None), (None, zone name), (None, None) where none is given; None for an unknown one."""
    z = g.get("zone")
    if not z:
        return None, None
    if z[0] in "+-":
        digits = z[1:].replace(":", "").ljust(4, "0")
        if int(digits[:2]) > 18 or int(digits[2:]) > 59:
            return None
        return (1 if z[0] == "+" else -1) * (int(digits[:2]) * 60 + int(digits[2:])), None
    if z in ABBREVIATIONS:
        return ABBREVIATIONS[z], None
    return (None, _ZONES[z]) if z in _ZONES else None


def read(text: str | None) -> Reading | None:
    """(chain, readings by ORDERS, zone). Chain is '' where all orders read the same; zone is '' if absolute, None if the text has none."""
    if text is None:
        return None
    s = " ".join(text.lower().split())
    if not s or not any(ch.isdigit() for ch in s):
        return None
    if e := _EPOCH.match(s):
        whole, frac = e[1], e[2] or ""
        n = len(whole)
        if n == 19:
            return "", [int(whole) // 1000] * 3, ""
        unit = _MS[n]
        return "", [int(whole) * unit + (int(frac[:6].ljust(6, "0")) * unit // 10**6 if frac else 0)] * 3, ""
    if (e := _WEEK.match(s)) or (e := _ORDINAL.match(s)):
        try:
            if e.re is _WEEK:
                day = date.fromisocalendar(int(e[1]), int(e[2]), int(e[3]))
            else:
                day = date(int(e[1]), 1, 1) + timedelta(days=int(e[2]) - 1)
                if day.year != int(e[1]) or int(e[2]) < 1:
                    return None
        except ValueError:
            return None
        g = e.groupdict()
        return _placed("", [_micros(day.year, day.month, day.day, g)] * 3, g)
    if e := _NUMERIC.match(s):
        g = e.groupdict()
        a, b, c = int(g["a"]), int(g["b"]), int(g["c"])
        if len(g["c"]) == 4:
            return _placed(g["sep"], [_micros(c, b, a, g), _micros(c, a, b, g), None], g)
        full = lambda y: y + (2000 if y < 70 else 1900)
        return _placed(g["sep"], [_micros(full(c), b, a, g), _micros(full(c), a, b, g), _micros(full(a), b, c, g)], g)
    for r in _RE:
        if e := r.match(s):
            g = e.groupdict()
            m = int(g["m"]) if g["m"].isdigit() else _MONTHS.get(g["m"])
            if m is None:
                continue
            return _placed("", [_micros(int(g["y"]), m, int(g["d"]), g)] * 3, g)
    return None


def _placed(chain: str, readings: list[int | None], g: dict) -> Reading | None:
    place = _zone(g)
    if place is None or not any(x is not None for x in readings):
        return None
    offset, name = place
    if offset is not None:
        return chain, [None if x is None else x - offset * 60 * 10**6 for x in readings], ""
    return chain, readings, name


def as_datetime(micros: int) -> datetime:
    return datetime(1970, 1, 1) + timedelta(microseconds=micros)
