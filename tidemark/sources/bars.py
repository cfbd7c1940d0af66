"""Bar tables: symbol, date, pos, open, high, low, close, volume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.scans import numbered

BAR_COLUMNS = ("symbol", "date", "pos", "open", "high", "low", "close", "volume")


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


#: Days of a block, by which a symbol's bars are numbered.
BLOCK_DAYS = 4096


def with_pos(df: DataFrame, days: int = BLOCK_DAYS) -> DataFrame:
    """Add the bar's 0-based position in its symbol; horizons and lookbacks count
    bars. Symbols are numbered by ranges of dates, so that a long one is many tasks."""
    return numbered(df, ["symbol"], "date", "pos", bucket=F.floor(F.unix_date(F.to_date("date")) / days))


def bars_from_orders(orders: DataFrame) -> DataFrame:
    """Daily bars of a deterministic random walk for each order priority."""
    daily = orders.groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("date")).agg(
        F.avg("o_totalprice").alias("m"),
        F.max("o_totalprice").alias("mx"),
        F.min("o_totalprice").alias("mn"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )
    order = Window.partitionBy("symbol").orderBy("date")
    step = (F.col("m") - 252500) / 252500 * 0.02 * F.sqrt("volume")
    walk = F.round(100 * F.exp(F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, 0))), 4)
    df = daily.withColumn("close", walk)
    df = df.withColumn("open", F.coalesce(F.lag("close").over(order), F.lit(100.0)))
    return df.select(
        "symbol",
        "date",
        (F.row_number().over(order) - 1).alias("pos"),
        "open",
        F.round(F.greatest("open", "close") * (1 + 0.005 * F.col("mx") / 500000), 4).alias("high"),
        F.round(F.least("open", "close") * (1 - 0.005 * (1 - F.col("mn") / 500000)), 4).alias("low"),
        "close",
        "volume",
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_orders(spark.read.parquet(f"{sf_dir}/orders.parquet"))


def hourly_bars(events: DataFrame) -> DataFrame:
    """Hourly bars of event values, a symbol for each event type; ties by event_id."""
    keyed = events.select(
        F.col("event_type").alias("symbol"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"),
        F.struct("ts", "event_id").alias("at"),
        "value",
    )
    return keyed.groupBy("symbol", "hour").agg(
        F.min_by("value", "at").alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", "at").alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )


def clean_bars(raw: DataFrame) -> DataFrame:
    """Vendor rows to bars: the last row of a date by ``ingest_seq`` wins, and
    only then are rows with a missing value dropped (a null duplicate that came
    last removes its date)."""
    values = ["open", "high", "low", "close", "volume"]
    require(raw, "symbol", "date", "ingest_seq", *values)
    last = Window.partitionBy("symbol", "date").orderBy(F.col("ingest_seq").desc())
    kept = raw.withColumn("_n", F.row_number().over(last)).where("_n = 1").dropna(subset=values)
    kept = kept.select(F.upper(F.trim("symbol")).alias("symbol"), F.to_date("date").alias("date"), *values)
    return with_pos(kept).select(*BAR_COLUMNS)


def missing_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, and nulls in each column and in all, per symbol."""
    nulls = {c: F.count_if(F.col(c).isNull()) for c in columns}
    total = sum((n for n in nulls.values()), F.lit(0).cast("long"))
    return df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(columns)).alias("n_columns"),
        total.alias("total_missing"),
        *[n.alias(f"missing_{c}") for c, n in nulls.items()],
    )
