"""Common table expressions that oracle statements share."""

from __future__ import annotations

from fringeflow.sources.virtual import DATES_SQL, SLC_SQL

AMP = 'amp AS (SELECT scene, t, "row", col, re, im, sqrt(re * re + im * im) AS a, atan2(im, re) AS p FROM slc)'
STATS = (
    'stats AS (SELECT scene, "row", col, n, mean, std / nullif(mean, 0) AS dispersion, std * std AS var FROM '
    '(SELECT scene, "row", col, count(nullif(a, 0)) AS n, avg(nullif(a, 0)) AS mean, stddev_pop(nullif(a, 0)) AS std FROM amp GROUP BY ALL))'
)
#: Consecutive dates and all that are at most two apart, by place.
PAIRS = (
    "ranked AS (SELECT scene, t, dt, row_number() OVER (PARTITION BY scene ORDER BY t) - 1 AS i FROM dates), "
    "pairs AS (SELECT a.scene, a.t AS ref_t, b.t AS sec_t, a.dt AS ref_dt, b.dt AS sec_dt, a.i AS ref_i, b.i AS sec_i "
    "FROM ranked a JOIN ranked b ON a.scene = b.scene AND a.i < b.i)"
)
_PARTS = {"slc": SLC_SQL, "dates": DATES_SQL, "amp": AMP, "stats": STATS, "pairs": PAIRS}


def offsets(found: list[tuple[int, int]]) -> str:
    return "offsets AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {r}, {c})" for i, (r, c) in enumerate(found)) + ") AS v(rank, dr, dc))"


def with_(parts: str, select: str, *more: str) -> str:
    """WITH the named parts and further definitions, then the select."""
    return "WITH " + ", ".join([*(_PARTS[p] for p in parts.split()), *more]) + " " + select


def r(expression: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {name or expression}"
