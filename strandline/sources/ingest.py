"""Landing raw tables: scan, canonical names, long form, catalog, market proxy, sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed as X
from ..functions.columns import clip, log_ratio, running, series, values_table

PRICE_SCHEMA = T.StructType([
    T.StructField("ticker", T.StringType()), T.StructField("date", T.DateType()),
    *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "adj_close", "volume")],
])


def scan(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet scan of every entity of a source; with a schema only its columns are read."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(*([path] if isinstance(path, str) else path))


def entity_from_file(suffix: str = "") -> Column:
    """Upper-case entity name taken from the file a row was read from."""
    return F.upper(F.regexp_extract(F.col("_metadata.file_name"), f"^(.*?){suffix}\\.parquet$", 1))


def split_entity(entity: Column | str) -> tuple[Column, Column]:
    """`series__economy` -> (series, upper-case economy or NULL)."""
    parts = F.split(entity, "__")
    return parts[0], F.upper(F.get(parts, F.lit(1)))


def canonical_name(name: str, source: str) -> str:
    key = " ".join(name.strip().lower().replace("_", " ").split())
    return X.COLUMN_ALIASES.get(source, {}).get(key, name)


def canonical_columns(df: DataFrame, source: str) -> DataFrame:
    """Rename provider aliases; columns that land on one name collapse to their first non-null value."""
    temp = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    groups: dict[str, list[str]] = {}
    for i, name in enumerate(df.columns):
        groups.setdefault(canonical_name(name, source), []).append(f"_{i}")
    return temp.select(*[F.coalesce(*[F.col(c) for c in cs]).alias(name) for name, cs in groups.items()])


def with_adjusted_close(df: DataFrame) -> DataFrame:
    if "Adj Close" in df.columns:
        return df.withColumn("Adj Close", F.coalesce("Adj Close", "Close"))
    return df.withColumn("Adj Close", F.col("Close"))


def years_to_long(df: DataFrame, ids: Sequence[str], prefix: str = "YR") -> DataFrame:
    """Unpivot `YR2020`-style columns to (ids, date text, value)."""
    years = [c for c in df.columns if c not in ids]
    return df.unpivot(list(ids), years, "year_column", "value").withColumn(
        "Date", F.regexp_replace("year_column", f"^{prefix}", "")).drop("year_column")


def year_end_dates(df: DataFrame, date: str = "Date", economy: str = "economy") -> DataFrame:
    """Year-like values become Dec 31, other text is parsed, invalid dates go, a missing economy is WLD."""
    text = F.trim(F.col(date).cast("string"))
    year = F.expr(f"try_cast({date} AS INT)")
    parsed = F.when(year.between(1800, 2200), F.make_date(year, F.lit(12), F.lit(31))).otherwise(
        F.try_to_timestamp(text).cast("date"))
    return df.withColumn(date, parsed).where(F.col(date).isNotNull()).withColumn(
        economy, F.upper(F.coalesce(economy, F.lit("WLD"))))


def required_columns(df: DataFrame, source: str) -> DataFrame:
    """(source, n_rows, missing, ok): schema difference against the source's required raw columns."""
    arr = lambda xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")
    return df.agg(F.count("*").alias("n_rows")).select(
        F.lit(source).alias("source"), "n_rows",
        F.array_except(arr(X.REQUIRED_RAW[source]), arr(df.columns)).alias("missing"),
    ).withColumn("ok", F.size("missing") == 0)


def with_ingest_audit(df: DataFrame, source: str) -> DataFrame:
    return df.withColumn("ingested_at", F.current_timestamp()).withColumn("source_system", F.lit(source))


def write_parquet(df: DataFrame, path: str, layer: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Raw tables are snappy, cleaned and wide tables zstd."""
    w = df.write.mode(mode).option("compression", "snappy" if layer == "raw" else "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_result(df: DataFrame, path: str, fmt: str, mode: str = "overwrite") -> None:
    """Result tables as CSV with header, records as JSON lines."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.json(path)


def catalog(raw: DataFrame, stamp: str = "date") -> DataFrame:
    """(source, entity, rows, last_update)."""
    return raw.groupBy("source", "entity").agg(F.count("*").alias("rows"), F.max(stamp).alias("last_update"))


def market_proxy(prices: DataFrame) -> DataFrame:
    """Index from the mean log return per date of all tickers.

    Dates are calendar-bound after the mean, so the closing cumulative window is one short series.
    """
    px = prices.where(F.col("date").isNotNull() & F.col("adj_close").isNotNull())
    w = series("ticker")
    ret = px.withColumn("ret", log_ratio("adj_close", F.lag("adj_close").over(w))).where(F.col("ret").isNotNull())
    daily = ret.groupBy("date").agg(clip(F.avg("ret"), -X.PROXY_CLIP, X.PROXY_CLIP).alias("ret"))
    return daily.select("date", (100 * F.exp(F.sum("ret").over(running(Window.orderBy("date"))))).alias("value"))


def year_last(proxy: DataFrame) -> DataFrame:
    """Last value per year, stamped with Dec 31."""
    return proxy.groupBy(F.make_date(F.year("date"), F.lit(12), F.lit(31)).alias("date")).agg(
        F.max_by("value", "date").alias("value"))


def scaling_factor(text: Column) -> Column:
    """0.92 + (sum of character codes mod 17) / 100."""
    chars = F.filter(F.split(text, ""), lambda c: F.length(c) > 0)
    total = F.aggregate(F.transform(chars, lambda c: F.ascii(c)), F.lit(0), lambda a, x: a + x)
    return F.lit(0.92) + (total % 17) / 100.0


def fan_out_proxy(proxy: DataFrame, names: Sequence[tuple[str, str]]) -> DataFrame:
    """One scaled copy of the proxy per missing (series id, series name); the name list is fixed and short."""
    target = F.explode(F.array(*[F.struct(F.lit(i).alias("id"), F.lit(n).alias("name")) for i, n in names])).alias("t")
    return proxy.select("date", "value", target).select(
        F.col("t.name").alias("series"), "date",
        (F.col("value") * scaling_factor(F.concat(F.col("t.name"), F.col("t.id")))).alias("value"))


def ingest_summary(spark: SparkSession, cat: DataFrame, expected: Sequence[tuple[str, int]]) -> DataFrame:
    """(source, expected, success, failed, missing): entities with rows against the expected number."""
    done = cat.groupBy("source").agg(F.count_if(F.col("rows") > 0).alias("success"))
    exp = values_table(spark, ("source", "expected"), expected)
    ok = F.coalesce("success", F.lit(0).cast("long"))
    return exp.join(done, "source", "left").select(
        "source", "expected", ok.alias("success"), F.greatest(F.col("expected") - ok, F.lit(0)).alias("failed"),
        (ok == 0).alias("missing"))


def column_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mean, std, min, max) of numeric columns from one aggregate."""
    stats = [F.struct(F.lit(c).alias("column"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                      F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")) for c in columns]
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def fingerprint(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Order-free content fingerprint per key: xor and wrapped sum of row hashes, row count."""
    h = F.xxhash64(*[F.col(c) for c in df.columns])
    return df.withColumn("_h", h).groupBy(*keys).agg(
        F.bit_xor("_h").alias("hash_xor"), F.sum(F.col("_h").cast("decimal(38,0)")).alias("hash_sum"), F.count("*").alias("n_rows"))
