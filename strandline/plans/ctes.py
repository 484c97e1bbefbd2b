"""Common table expressions from which the comparison SQL is assembled.

`sql(body, *names)` prepends the named expressions and whatever they need, in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from ..functions import fixed as X
from ..functions.columns import values_sql
from ..sources.bindings import MACRO_BINDING

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (needs, body)


def sql(body: str, *names: str) -> str:
    done: list[str] = []

    def visit(n: str) -> None:
        if n in done:
            return
        for d in CTES[n][0]:
            visit(d)
        done.append(n)

    for n in names:
        visit(n)
    if not done:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in done) + "\n" + body


def bars_sql(ticker: str, unit: str) -> str:
    src = "lineitem JOIN part ON l_partkey = p_partkey" if ticker.startswith("p_") else "lineitem"
    return f"""SELECT upper({ticker}) AS ticker, CAST(date_trunc('{unit}', l_shipdate) AS DATE) AS date,
      avg(l_extendedprice / l_quantity) AS open, max(l_extendedprice / l_quantity) AS high,
      min(l_extendedprice / l_quantity) AS low, sum(l_extendedprice) / sum(l_quantity) AS close,
      sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity) AS adj_close, sum(l_quantity) AS volume
    FROM {src} GROUP BY 1, 2"""


cte("px", bars_sql("p_type", "week"))
cte("px_day", bars_sql("p_brand", "day"))
cte("px_flag", bars_sql("l_returnflag", "day"))
cte("macro", "SELECT CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MACRO_BINDING.items())
    + " END AS series, last_day(o_orderdate) AS date, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2")
cte("ind_base", """SELECT upper(substr(r_name, 1, 3)) AS economy, make_date(CAST(year(o_orderdate) AS INT), 12, 31) AS date,
    sum(o_totalprice) AS s, count(*) AS n
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
cte("ind", """SELECT 'gdp_growth' AS series, economy, date, s / 1e6 AS value FROM ind_base
    UNION ALL SELECT 'trade_openness', economy, date, s / n / 1e3 FROM ind_base""", "ind_base")
cte("ops", """SELECT ts, event_type AS operation, user_id AS component, value AS duration_seconds,
    event_type <> 'error' AS success, event_id FROM events""")
cte("sectors", "SELECT upper(p_type) AS ticker, min(p_brand) AS sector FROM part GROUP BY 1")
cte("px_dirty", """SELECT ticker, date, s.seq, open, high, low, volume,
    CASE WHEN day(date) <= 3 THEN NULL WHEN month(date) = 12 AND day(date) >= 25 THEN close * 50 ELSE close END AS close,
    CASE WHEN day(date) <= 3 THEN NULL WHEN month(date) = 12 AND day(date) >= 25 THEN adj_close * 50 ELSE adj_close END AS adj_close
    FROM px JOIN (VALUES (0), (1)) AS s(seq) ON s.seq = 0 OR (ticker = 'PROMO' AND day(date) BETWEEN 14 AND 16)""", "px")
cte("raw", """
    SELECT 'yfinance' AS source, ticker AS entity, NULL AS economy, date, CAST(seq AS BIGINT) AS seq, measure, value
      FROM px_dirty UNPIVOT INCLUDE NULLS (value FOR measure IN (open, high, low, close, adj_close, volume))
    UNION ALL SELECT 'fred', series, NULL, date, 0, 'value',
      CASE WHEN series = 'industrial_production' AND month(date) IN (1, 2, 11, 12) THEN NULL ELSE value END FROM macro
    UNION ALL SELECT 'worldbank', series || '__' || lower(economy), economy, date, 0, 'value', value FROM ind""",
    "px_dirty", "macro", "ind")
cte("contracts", values_sql(X.CONTRACT_COLUMNS, X.CONTRACTS))


def inverse_sql(source: str, keys: str, size: int, carry: str) -> str:
    """Gauss-Jordan elimination of the first `size` columns of matrix `a` (a list of rows) of every row of `source`, written as a recursion."""
    swept = ("list_transform(a, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / a[k][k]) "
             "ELSE list_transform(r, lambda v, j: v - r[k] / a[k][k] * a[k][j]) END)")
    return f"""WITH RECURSIVE s AS (SELECT {keys}, {carry}, a, 1 AS k FROM {source} UNION ALL SELECT {keys}, {carry}, {swept}, k + 1 FROM s WHERE k <= {size})
    SELECT {keys}, {carry}, a FROM s WHERE k = {size + 1}"""


def least_squares(name: str, source: str, keys: str, xs: Sequence[str], y: str, *needs: str, alpha: str = "0", scaled: bool = True, used: Sequence[str] | None = None) -> None:
    """CTE `name`: keys, n, b (coefficients), c0 (intercept), sd, inv (diagonal of the inverse), rss, tss of a penalised regression per group.

    The penalty acts on factors divided by their deviation, or on plain ones; `used` has a condition per factor (over the columns
    of the grouped row) without which it takes no part.
    """
    p = len(xs)
    on = used or ["TRUE"] * p
    sd = ", ".join(f"CASE WHEN stddev_pop({x}) > 0 THEN stddev_pop({x}) ELSE 1.0 END" if scaled else "1.0::DOUBLE" for x in xs)
    cov = ", ".join("[" + ", ".join(f"covar_pop({a}, {b})" for b in xs) + "]" for a in xs)
    cte(f"{name}_m", f"""SELECT {keys}, count(*) AS n, avg({y}) AS my, var_pop({y}) AS vy, [{", ".join(f"avg({x})" for x in xs)}] AS mx, [{sd}] AS sd, [{cov}] AS c, [{", ".join(f"covar_pop({x}, {y})" for x in xs)}] AS cy
    FROM {source} GROUP BY {keys}""", *needs)
    rows = []
    for i in range(1, p + 1):
        cells = [f"CASE WHEN ({on[i - 1]}) AND ({on[j - 1]}) THEN c[{i}][{j}] / sd[{i}] / sd[{j}]{f' + ({alpha}) / n' if i == j else ''} ELSE {float(i == j)}::DOUBLE END" for j in range(1, p + 1)]
        rows.append("[" + ", ".join([*cells, f"CASE WHEN {on[i - 1]} THEN cy[{i}] / sd[{i}] ELSE 0.0::DOUBLE END", *(f"{float(i == j)}::DOUBLE" for j in range(1, p + 1))]) + "]")
    cte(f"{name}_a", f"SELECT {keys}, n, my, vy, mx, sd, c, cy, [{', '.join(rows)}] AS a FROM {name}_m", f"{name}_m")
    cte(f"{name}_s", inverse_sql(f"{name}_a", keys, p, "n, my, vy, mx, sd, c, cy"), f"{name}_a")
    b = ", ".join(f"a[{i}][{p + 1}] / sd[{i}]" for i in range(1, p + 1))
    cte(name, f"""SELECT *, my - list_dot_product(b, mx) AS c0, n * vy AS tss, n * (vy - 2 * list_dot_product(b, cy) + list_sum(list_transform(c, lambda r, i: b[i] * list_dot_product(b, r)))) AS rss FROM (
    SELECT {keys}, n, my, vy, mx, sd, c, cy, [{b}] AS b, [{", ".join(f"a[{i}][{p + 1 + i}]" for i in range(1, p + 1))}] AS inv FROM {name}_s)""", f"{name}_s")


def fitted_sql(xs: Sequence[str], model: str = "f", row: str = "r") -> str:
    return f"{model}.c0 + " + " + ".join(f"{model}.b[{i + 1}] * {row}.{x}" for i, x in enumerate(xs))


def tail_sql(t: str) -> str:
    """Two-sided normal tail by the power series of the error function; below 1e-8 beyond 6 deviations."""
    x = f"(least(abs({t}), 6.0) / sqrt(2.0))"
    term = f"list_sum(list_transform(range(0, 120), lambda i: pow(-1, i) * exp((2 * i + 1) * ln(greatest({x}, 1e-300)) - lgamma(i + 1)) / (2 * i + 1)))"
    return f"greatest(0.0, 1 - 2 / sqrt(pi()) * {term})"
