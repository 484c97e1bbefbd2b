"""Column expressions used by every operator.

Row position is part of the meaning here: lags and rolling windows count rows of a series, not days.
A *series* is a set of rows with one row per (keys, date). Its length is therefore bounded by the
calendar (about 36,500 rows per century), so a window over one series always fits one task, however
many raw rows fed it. `sources.bindings` and `operators.gold` establish that uniqueness first.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, int):
        return f"CAST({v} AS BIGINT)"
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    return "'" + str(v).replace("'", "''") + "'"


def values_sql(columns: Sequence[str], rows: Iterable[Sequence]) -> str:
    """`SELECT ... FROM (VALUES ...)` text for a fixed parameter table."""
    body = ", ".join("(" + ", ".join(sql_literal(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS fixed({', '.join(columns)})"


def values_table(spark: SparkSession, columns: Sequence[str], rows: Iterable[Sequence]) -> DataFrame:
    """A fixed parameter table as a local relation (its size is that of the literal list)."""
    return spark.sql(values_sql(columns, rows))


def clip(c, lo, hi) -> Column:
    """Clip, keeping NULL as NULL (`greatest`/`least` alone would turn it into a bound)."""
    c = col(c)
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.when(c.isNotNull(), F.greatest(lo, F.least(hi, c)))


def finite(c) -> Column:
    """NaN and infinities become NULL."""
    c = col(c)
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def div(a, b) -> Column:
    """Division that yields NULL on a zero divisor."""
    return F.try_divide(col(a), col(b))


def log_ratio(now, before) -> Column:
    now, before = col(now), col(before)
    return F.when((now > 0) & (before > 0), F.log(now / before))


def series(keys: str | Sequence[str], order: str | Sequence[str] = "date") -> WindowSpec:
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*keys).orderBy(*order)


def whole(keys: str | Sequence[str]) -> WindowSpec:
    keys = [keys] if isinstance(keys, str) else list(keys)
    return Window.partitionBy(*keys)


def running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def rolling(fn, c, w: WindowSpec, n: int, min_rows: int | None = None) -> Column:
    """`fn` over the last n rows, NULL until min_rows non-null values were seen."""
    c = col(c)
    f = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(f) >= (min_rows or n), fn(c).over(f))


def ffill(c, w: WindowSpec) -> Column:
    return F.last(col(c), ignorenulls=True).over(running(w))


def bfill(c, w: WindowSpec) -> Column:
    return F.first(col(c), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))


def drawdown(cum, w: WindowSpec) -> Column:
    """Drawdown of exp(cum) against its running peak; the peak starts at the first value."""
    cum = col(cum)
    return F.exp(cum - F.max(cum).over(running(w))) - 1


def messages(*pairs: tuple[Column, str | Column]) -> Column:
    """Array of the messages whose condition holds, in the order given."""
    items = [F.when(cond, m if isinstance(m, Column) else F.lit(m)) for cond, m in pairs]
    return F.array_compact(F.array(*items))


def nudge(digits: int) -> float:
    """Offset added before rounding for comparison.

    Quotients of cents often lie exactly on a rounding edge, where the last bit of a sum decides. The
    offset moves the edge to where such values do not lie; both sides of a comparison add it.
    """
    return float(f"0.137e-{digits}")


def nudged(c, digits: int) -> Column:
    return F.round(col(c) + nudge(digits), digits)


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round double columns for stable comparison; `special` sets digits per column."""
    out = []
    for name, typ in df.dtypes:
        out.append(nudged(finite(name), special.get(name, digits)).alias(name) if typ == "double" else F.col(name))
    return df.select(*out)
