"""Plain Python versions of the core operators, row by row, to compare with."""

import re
import unicodedata
from collections import defaultdict
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from sporlake.functions.readings import as_datetime, read

UTC = timezone.utc


def canonical(v):
    s = " ".join(unicodedata.normalize("NFC", v or "").lower().split())
    if m := re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)(t00:00:00(\.0+)?(z|\+00:00)?)?", s):
        return m[1] + m[2] + m[3]
    if m := re.fullmatch(r"(\d\d?)\.(\d\d?)\.(\d{4})", s):
        return m[3] + m[2].zfill(2) + m[1].zfill(2)
    if re.fullmatch(r"((nok|kr) ?)?\d[\d ., ]*", s):
        n = re.sub(r"[a-z\s]", "", s)
        if re.fullmatch(r"\d{1,3}(\.\d{3})+(,\d*)?", n):
            n = n.replace(".", "").replace(",", ".")
        elif re.fullmatch(r"\d{1,3}(,\d{3})+(\.\d*)?", n):
            n = n.replace(",", "")
        else:
            n = n.replace(",", ".")
        return n.rstrip("0").rstrip(".") if "." in n else n
    if s in ("true", "false"):
        return "1" if s == "true" else "0"
    if "." in s and " " not in s:
        return re.sub(r"/+$", "", re.sub(r"^(https?://)?(www\.)?", "", s))
    return s


def at(text):
    return datetime.fromisoformat(text.replace("Z", "+00:00")) if text else datetime(1, 1, 1, tzinfo=UTC)


def changes(rows):
    """rows: (version, key, value, retrieved_at)"""
    best = {}
    for v, k, x, t in rows:
        if (v, k) not in best or at(t) > best[v, k][0]:
            best[v, k] = (at(t), canonical(x))
    by = defaultdict(dict)
    for (v, k), (_, x) in best.items():
        by[v][k] = x
    out, vs = set(), sorted(by)
    for a, b in zip(vs, vs[1:]):
        for k in by[a].keys() | by[b].keys():
            if k not in by[a]:
                out.add((a, b, k, "added"))
            elif k not in by[b]:
                out.add((a, b, k, "removed"))
            elif by[a][k] != by[b][k]:
                out.add((a, b, k, "changed"))
    return out


def day_of(e, t):
    e = (e or "").strip()
    for r, o in ((r"(\d{4})-(\d\d)-(\d\d)(T.*)?$", (1, 2, 3)), (r"(\d{4})(\d\d)(\d\d)$", (1, 2, 3)), (r"(\d\d)\.(\d\d)\.(\d{4})$", (3, 2, 1))):
        if m := re.match(r, e):
            return "-".join(m[i] for i in o)
    return at(t).astimezone(UTC).date().isoformat()


def history(rows):
    """rows: (id, key, value, effective_date, retrieved_at)"""
    best = defaultdict(dict)
    for i, k, x, e, t in rows:
        d = day_of(e, t)
        if d not in best[k] or (at(t), i) > best[k][d][0]:
            best[k][d] = ((at(t), i), canonical(x))
    out = set()
    for k, days in best.items():
        open_, since = "", None
        for d in sorted(days):
            x = days[d][1]
            if x != open_:
                if open_:
                    out.add((k, since, d))
                open_, since = x, d
        if open_:
            out.add((k, since, "9999-12-31"))
    return out


def utc_times(rows, zones):
    """rows: (id, field, text, source); each source writes numeric dates of one kind in the order most of them allow."""
    votes = defaultdict(lambda: [0, 0, 0])
    got = [(i, f, s, read(x)) for i, f, x, s in rows]
    for _, _, s, r in got:
        if r and r[0]:
            for k in range(3):
                votes[s, r[0]][k] += r[1][k] is not None
    out = set()
    for i, f, s, r in got:
        if not r:
            continue
        v = votes[s, r[0]]
        m = r[1][v.index(max(v))]
        if m is None:
            continue
        t = as_datetime(m)
        zone = r[2] if r[2] is not None else zones.get(s) or ""
        if zone:
            t = t.replace(tzinfo=ZoneInfo(zone)).astimezone(UTC)
        out.add((i, f, t.strftime("%Y-%m-%dT%H:%M:%S.%fZ")))
    return out
