"""Composite states and conditional forecasts that fall back to fewer conditions.

A record is a base state with up to four modifiers. Level 4 keeps all of them,
level 0 none. Counts of states and transitions are made for all levels at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.storage import stored
from ..sources.store import save_csv

MODIFIERS = ("volatility_state", "macro_state", "calendar_state", "liquidity_state")
HIGH, LOW = 50, 30
LEVELS = tuple(range(len(MODIFIERS) + 1))

# The forecast table's columns.
FORECAST_COLUMNS = (
    "symbol", "date", "base_state", "conditions_requested", "conditions_used", "fallback_level", "sample_count",
    "probability", "expected_value_after_cost", "cost_model_used", "confidence", "historical_stability",
    "invalidation_trigger", "warnings",
)


def composite_key(level: Column | int = 4) -> Column:
    """base|vol|macro|calendar|liquidity, with * for what is unknown or above the level."""
    level = F.lit(level) if isinstance(level, int) else level
    parts = [F.coalesce(F.when(level > i, F.nullif(F.col(m), F.lit(""))), F.lit("*")) for i, m in enumerate(MODIFIERS)]
    base = F.when(F.coalesce(F.col("base_state"), F.lit("")) == "", F.raise_error(F.lit("a record needs a base state")).cast("string"))
    return F.concat_ws("|", base.otherwise(F.col("base_state")), *parts)


def overridden(records: DataFrame, **changes) -> DataFrame:
    """Records with some fields set to other values (columns, texts or None: unknown); others stay. A name that is no field is an error."""
    unknown = set(changes) - {"base_state", *MODIFIERS}
    if unknown:
        raise ValueError(f"no fields of a record: {', '.join(sorted(unknown))}")
    return records.withColumns({c: v if isinstance(v, Column) else F.lit(v).cast("string") for c, v in changes.items()})


def leveled(records: DataFrame) -> DataFrame:
    """A row for each record and fallback level, with its key and the next record's."""
    exploded = records.withColumn("level", F.explode(F.array(*[F.lit(x) for x in LEVELS])))
    keyed = exploded.withColumn("key", composite_key(F.col("level")))
    order = Window.partitionBy("symbol", "level").orderBy("pos")
    return keyed.withColumns({"next_key": F.lead("key").over(order), "next_base": F.lead("base_state").over(order)})


def state_counts(levels: DataFrame) -> DataFrame:
    return levels.groupBy("symbol", "level", "key").agg(F.count(F.lit(1)).alias("n"))


def transition_counts(levels: DataFrame, gap: str | None = None) -> DataFrame:
    """Counts of (key, next key); a pair whose next bar opens a segment (``gap``) is left out."""
    pairs = levels
    if gap:
        order = Window.partitionBy("symbol", "level").orderBy("pos")
        pairs = levels.withColumn("_gap", F.lead(gap).over(order)).where(~F.coalesce(F.col("_gap"), F.lit(False)))
    return pairs.where("next_key IS NOT NULL").groupBy("symbol", "level", "key", "next_key").agg(F.count(F.lit(1)).alias("n"))


def coverage(counts: DataFrame) -> DataFrame:
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("symbol", "level")))


def transition_coverage(counts: DataFrame) -> DataFrame:
    return counts.withColumn("row_share", F.col("n") / F.sum("n").over(Window.partitionBy("symbol", "level", "key")))


def rare_keys(counts: DataFrame, min_count: int = LOW) -> DataFrame:
    return counts.where(F.col("n") < min_count)


def confidence(n: Column) -> Column:
    return F.when(n >= HIGH, "high").when(n >= LOW, "medium").otherwise("low")


def conditional_forecast(history: DataFrame, asked: DataFrame) -> DataFrame:
    """Forecast the records ``asked`` (symbol, pos, base_state, modifiers) from ``history``.

    The finest level with 30 samples is found; below 50 it gives way to one
    level less, unchecked; without any, level 0. From there down, the first
    level with outgoing transitions is used. If there is none the chosen level
    stays, with an empty map. Returns the level, count, probabilities of the
    next keys, confidence and warnings.
    """
    levels = leveled(history.select("symbol", "pos", "base_state", *MODIFIERS))
    counts = state_counts(levels)
    moves = transition_coverage(transition_counts(levels)).groupBy("symbol", "level", "key").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("next_key", "row_share")))).alias("probs")
    )
    own = asked.select("symbol", "pos", "base_state", *MODIFIERS)
    keyed = own.withColumn("level", F.explode(F.array(*[F.lit(x) for x in LEVELS]))).withColumn("key", composite_key(F.col("level")))
    seen = keyed.join(counts, ["symbol", "level", "key"], "left").join(moves, ["symbol", "level", "key"], "left")
    each = F.struct("level", "key", F.coalesce("n", F.lit(0)).alias("n"), "probs")
    per = seen.groupBy("symbol", "pos").agg(F.array_sort(F.collect_list(each), lambda a, b: a["level"] - b["level"]).alias("at"), F.first("base_state").alias("base_state"))
    best = F.array_max(F.transform(F.filter("at", lambda x: x["n"] >= LOW), lambda x: x["level"]))
    per = per.withColumn("_best", best)
    full = F.get("at", F.col("_best"))["n"] >= HIGH
    per = per.withColumn("_chosen", F.when(F.col("_best").isNull(), 0).when(full, F.col("_best")).otherwise(F.greatest(F.col("_best") - 1, F.lit(0))))
    usable = F.array_max(F.transform(F.filter("at", lambda x: (x["level"] <= F.col("_chosen")) & x["probs"].isNotNull()), lambda x: x["level"]))
    per = per.withColumn("_used", usable)
    level = F.coalesce("_used", "_chosen")
    n = F.get("at", level)["n"]
    warnings = F.array_compact(
        F.array(F.when(level < len(MODIFIERS), "fallback_used"), F.when(n < LOW, "low_sample"), F.when(F.col("_used").isNull(), "no_transitions"))
    )
    empty = F.create_map().cast("map<string,double>")
    return per.select(
        "symbol",
        "pos",
        "base_state",
        F.get("at", F.lit(len(MODIFIERS)))["key"].alias("requested_key"),
        F.get("at", level)["key"].alias("used_key"),
        level.alias("fallback_level"),
        n.cast("long").alias("sample_count"),
        F.coalesce(F.get("at", level)["probs"], empty).alias("next_probs"),
        confidence(n).alias("confidence"),
        warnings.alias("warnings"),
    )


def with_stress(df: DataFrame, stress: str) -> DataFrame:
    """Append the cross-asset level to the warnings and cap the confidence under stress."""
    s, c = F.col(stress), F.col("confidence")
    return df.withColumns(
        {
            "confidence": F.when((s == "STRESS") & (c == "high"), "medium").when(s == "PANIC", "low").otherwise(c),
            "warnings": F.array_append("warnings", F.concat(F.lit("cross_asset_"), F.lower(s))),
        }
    )


def with_tail_risk(df: DataFrame, score: str, lower: float = 0.75, block: float = 0.90) -> DataFrame:
    """Lower the confidence a notch from ``lower``; from ``block`` it is low and all probabilities are 0."""
    s, c = F.col(score), F.col("confidence")
    notch = F.when(c == "high", "medium").otherwise("low")
    return df.withColumns(
        {
            "confidence": F.when(s >= block, "low").when(s >= lower, notch).otherwise(c),
            "next_probs": F.when(s >= block, F.transform_values("next_probs", lambda k, v: v * 0)).otherwise(F.col("next_probs")),
        }
    )


def with_warning(df: DataFrame, condition: Column, warning: str) -> DataFrame:
    """Append a warning where the condition holds (reflexivity, few analogues)."""
    held = F.coalesce(condition, F.lit(False))
    return df.withColumn("warnings", F.when(held, F.array_append("warnings", F.lit(warning))).otherwise(F.col("warnings")))


def forecast_rows(df: DataFrame, next_state: str) -> DataFrame:
    """The fixed forecast table: ``probability`` is that of ``next_state``, null if unseen."""
    known = {
        "conditions_requested": F.col("requested_key"),
        "conditions_used": F.col("used_key"),
        "probability": F.try_element_at("next_probs", F.col(next_state)),
    }
    out = []
    for name in FORECAST_COLUMNS:
        if name in known:
            out.append(known[name].alias(name))
        elif name in df.columns:
            out.append(F.col(name))
        else:
            out.append(F.lit(None).cast("string").alias(name))
    return df.select(*out)


def fallback_usage(forecasts: DataFrame) -> DataFrame:
    counts = forecasts.groupBy("fallback_level").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def confidence_panel(forecasts: DataFrame) -> DataFrame:
    """Counts of all three tiers, in their order, also of those without any."""
    tiers = forecasts.sparkSession.createDataFrame([("high", 0), ("medium", 1), ("low", 2)], "confidence string, tier int")
    counts = forecasts.groupBy("confidence").agg(F.count(F.lit(1)).alias("n"))
    out = tiers.join(counts, "confidence", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return out.withColumn("share", F.col("n") / F.nullif(F.sum("n").over(Window.partitionBy()), F.lit(0)))


def rarest(counts: DataFrame, top: int = 20) -> DataFrame:
    """The ``top`` rarest keys: a report's limit."""
    return counts.orderBy("n", "symbol", "key").limit(top)


def coverage_by_symbol(forecasts: DataFrame) -> DataFrame:
    return forecasts.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_forecasts"), F.avg("sample_count").alias("mean_samples"), F.avg("fallback_level").alias("mean_level")
    )


def warning_counts(forecasts: DataFrame) -> DataFrame:
    return forecasts.select(F.explode("warnings").alias("warning")).groupBy("warning").agg(F.count(F.lit(1)).alias("n"))


def diagnostics(history: DataFrame, asked: DataFrame, folder: str, top: int = 20) -> dict[str, str]:
    """Fit once on ``history``, forecast ``asked``, and write the five diagnostic tables as CSV: {name: path}."""
    made = stored(conditional_forecast(history, asked), "diagnostic-forecasts")
    # The rarest base states of all symbols together.
    bare = history.groupBy(F.lit("all").alias("symbol"), F.lit(0).alias("level"), composite_key(0).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    tables = {
        "fallback_usage": fallback_usage(made).orderBy("fallback_level"),
        "confidence_distribution": confidence_panel(made).orderBy("tier"),
        "top_rare_states": rarest(bare, top).select("key", "n"),
        "coverage_by_symbol": coverage_by_symbol(made).orderBy("symbol"),
        "forecast_warnings": warning_counts(made).orderBy(F.col("n").desc(), "warning"),
    }
    paths = {name: f"{folder.rstrip('/')}/{name}" for name in tables}
    for name, df in tables.items():
        save_csv(df, paths[name], single=True)
    return paths
