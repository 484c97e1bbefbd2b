"""Named queries and the SQL that states the same result for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import nudge

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def nudge_rounds(sql: str) -> str:
    """Add the comparison offset inside every lower-case round(x, n); ROUND(x, n) is a result's own rounding."""
    out, i = [], 0
    while (j := sql.find("round(", i)) >= 0:
        depth, k, comma = 1, j + 6, -1
        while depth:
            ch = sql[k]
            depth += (ch in "([") - (ch in ")]")
            if ch == "," and depth == 1:
                comma = k
            k += 1
        inner, digits = nudge_rounds(sql[j + 6:comma]), int(sql[comma + 1:k - 1])
        out += [sql[i:j], f"round(({inner}) + CAST('{nudge(digits)!r}' AS DOUBLE), {digits})"]
        i = k
    return "".join(out) + sql[i:]


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = nudge_rounds(sql)
        return fn
    return add
