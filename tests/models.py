"""Sequential models of the ordered folds, written from their rules and not from the set forms."""

from __future__ import annotations


def paced(arrivals, interval):
    out, last = [], None
    for a in arrivals:
        last = a if last is None else max(a, last + interval)
        out.append(last)
    return out


def serial(arrivals, services, interval):
    out, last, free = [], None, None
    for a, s in zip(arrivals, services, strict=True):
        last = a if last is None else max(a, last + interval, free)
        free = last + s
        out.append(last)
    return out


def rates(headers, configured):
    rps, out = configured, []
    for h in headers:
        rps = min(configured, max(0.5, h)) if h is not None else min(configured, rps * 1.05)
        out.append(rps)
    return out


def concurrency(headers, configured):
    now, out = configured, []
    for h in headers:
        if h is not None and h > 0:
            now = min(h, configured)
        out.append(now)
    return out


def reputations(kinds):
    rep, out = 1.0, []
    for k in kinds:
        rep = rep * 0.5 if k == "failure" else min(1.0, rep * (1.5 if k == "success" else 1.1))
        out.append(rep)
    return out


def first_eviction(kinds, times, stay):
    rep, since = 1.0, None
    for k, t in zip(kinds, times, strict=True):
        if k == "heartbeat":
            rep = min(1.0, rep * 1.1)
        elif k == "success":
            rep, since = min(1.0, rep * 1.5), None
        else:
            rep *= 0.5
            if rep > 0.05:
                since = None
            elif since is None:
                since = t
            elif t - since >= stay:
                return t
    return None


def admission(rows, base):
    """(key, allowed) in order -> (outcome, seconds told or None)."""
    known, streak, out = set(), 0, []
    for key, allowed in rows:
        if key in known:
            out.append(("duplicate", None))
        elif allowed:
            known.add(key)
            streak = 0
            out.append(("accepted", None))
        else:
            streak += 1
            first = base if base > 0 else 5
            out.append(("rejected", first if streak == 1 else min(60, first * 2 ** (streak - 1))))
    return out


def isolated(modes):
    on, out = False, []
    for m in modes:
        if m:
            on = m == "enabled"
        out.append(on)
    return out


def sessions(times, gap):
    out = []
    for t in sorted(times):
        if out and t - out[-1][1] <= gap:
            out[-1][1] = t
            out[-1][2] += 1
        else:
            out.append([t, t, 1])
    return [tuple(x) for x in out]


def picks(weights, n):
    """Weighted round robin by virtual time; ties to the lower id."""
    at = dict.fromkeys(weights, 0.0)
    out = []
    for _ in range(n):
        m = min(at, key=lambda k: (round(at[k], 9), k))
        out.append(m)
        at[m] += 1 / weights[m]
    return out
