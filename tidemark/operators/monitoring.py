"""Provider comparison and drift of state frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.constants import ALPHA, N_STATES
from ..functions.scans import BLOCK, blocked, numbered, running


def summarize_source(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, first and last date and nulls per symbol; a column the table lacks counts as all missing."""
    nulls = [
        (F.count_if(F.col(c).isNull()) if c in df.columns else F.count(F.lit(1))).alias(f"missing_{c}") for c in columns
    ]
    return df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), *nulls
    )


def compare_sources(left: DataFrame, right: DataFrame, close_tol: float = 0.01, volume_tol: float = 0.0) -> DataFrame:
    """Two providers' bars side by side, per symbol: overlap, what only one has, and differences above the tolerances."""
    a = left.select("symbol", "date", F.col("close").alias("c1"), F.col("volume").alias("v1"), F.lit(True).alias("in1"))
    b = right.select("symbol", "date", F.col("close").alias("c2"), F.col("volume").alias("v2"), F.lit(True).alias("in2"))
    both = a.join(b, ["symbol", "date"], "full_outer")
    shared = F.col("in1").isNotNull() & F.col("in2").isNotNull()
    dc, dv = F.when(shared, F.abs(F.col("c1") - F.col("c2"))), F.when(shared, F.abs(F.col("v1") - F.col("v2")))
    return both.groupBy("symbol").agg(
        F.count_if(shared).alias("overlap"),
        F.count_if(F.col("in2").isNull()).alias("left_only"),
        F.count_if(F.col("in1").isNull()).alias("right_only"),
        F.count_if(dc > close_tol).alias("close_mismatches"),
        F.count_if(dv > volume_tol).alias("volume_mismatches"),
        F.max(dc).alias("max_close_diff"),
        F.avg(dc).alias("mean_close_diff"),
    )


def merge_summaries(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Two providers' summaries side by side, their columns with the providers' names; symbols of one alone too."""
    one = left.withColumnsRenamed({c: f"{c}_{a}" for c in left.columns if c != "symbol"})
    two = right.withColumnsRenamed({c: f"{c}_{b}" for c in right.columns if c != "symbol"})
    return one.join(two, "symbol", "full_outer")


def provider_pivot(metrics: DataFrame, base: str, other: str, names: list[str]) -> DataFrame:
    """Mean metrics (symbol, provider, names) of two providers and their differences."""
    wide = metrics.groupBy("symbol").pivot("provider", [base, other]).agg(*[F.avg(n).alias(n) for n in names])
    if len(names) == 1:
        wide = wide.withColumnsRenamed({p: f"{p}_{names[0]}" for p in (base, other)})
    deltas = [(F.col(f"{other}_{n}") - F.col(f"{base}_{n}")).alias(f"{n}_delta") for n in names]
    return wide.select("*", *deltas)


def state_distribution(df: DataFrame, keys: list[str], n_states: int = N_STATES, alpha: float = ALPHA) -> DataFrame:
    """Smoothed shares (keys, state, p) over 0 .. n_states - 1; others are ignored; uniform if there is nothing."""
    if n_states < 2 or alpha < 0:
        raise ValueError("bad distribution options")
    counts = df.where(F.col("state").between(0, n_states - 1)).groupBy(*keys, "state").agg(F.count(F.lit(1)).alias("n"))
    grid = df.select(*keys).distinct().withColumn("state", F.explode(F.sequence(F.lit(0), F.lit(n_states - 1))))
    mass = F.coalesce("n", F.lit(0)) + alpha
    total = F.sum(mass).over(Window.partitionBy(*keys))
    return grid.join(counts, [*keys, "state"], "left").select(
        *keys, "state", F.coalesce(mass / F.nullif(total, F.lit(0.0)), F.lit(1.0 / n_states)).alias("p")
    )


def kl(p: Column, q: Column, eps: float = 1e-12) -> Column:
    """Kullback-Leibler divergence of grouped shares, in nats."""
    a, b = F.greatest(p, F.lit(eps)), F.greatest(q, F.lit(eps))
    return F.sum(a * (F.ln(a) - F.ln(b)))


def drift_monitor(df: DataFrame, recent: int = 60, threshold: float = 0.10, n_states: int = N_STATES) -> DataFrame:
    """Whether each symbol's last ``recent`` states have drifted from those before."""
    known = df.where("state IS NOT NULL").select("symbol", "pos", "state")
    order = Window.partitionBy("symbol").orderBy(F.col("pos").desc())
    split = known.withColumn("part", F.when(F.row_number().over(order) <= recent, "now").otherwise("past"))
    sizes = known.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_states_seen"))
    shares = state_distribution(split, ["symbol", "part"], n_states)
    sides = shares.groupBy("symbol", "state").agg(
        F.max(F.when(F.col("part") == "now", F.col("p"))).alias("p"), F.max(F.when(F.col("part") == "past", F.col("p"))).alias("q")
    )
    drift = sides.groupBy("symbol").agg(kl(F.col("p"), F.col("q")).alias("kl"))
    enough = F.col("n_states_seen") > recent
    return sizes.join(drift, "symbol").select(
        "symbol",
        "n_states_seen",
        F.when(enough, F.col("kl")).alias("kl"),
        (enough & (F.col("kl") >= threshold)).alias("alert"),
        F.when(enough, "ok").otherwise("insufficient_history").alias("status"),
    )


def rolling_drift(df: DataFrame, recent: int = 60, threshold: float = 0.10, n_states: int = N_STATES, alpha: float = ALPHA, block: int = BLOCK) -> DataFrame:
    """Drift as each bar knows it: (symbol, pos, n_seen, kl, alert).

    At a bar, the last ``recent`` known states, its own included, are compared
    with all known ones before them; later bars have no part in it. With too
    few for both sides kl is null and there is no alert. Histograms are arrays
    of running counts, of which two bars ``recent`` apart are subtracted; a
    symbol is cut into blocks, which take over the counts of those before.
    """
    if recent < 1 or n_states < 2 or alpha < 0:
        raise ValueError("bad drift options")
    known = numbered(df.where("state IS NOT NULL").select("symbol", "pos", F.col("state").cast("int").alias("state")), ["symbol"], "pos", "k", block)
    counted = {f"_c{s}": ("sum", F.when(F.col("state") == s, 1).otherwise(0)) for s in range(n_states)}
    so_far = running(known, ["symbol"], "k", counted, block).select("symbol", "pos", "k", F.array(*counted).alias("_now"))
    # The counts ``recent`` bars ago: an equal distance, so a window over a block and the rows before it.
    cut = blocked(so_far, "k", max(block, recent), recent)
    order = Window.partitionBy("symbol", "block").orderBy("k")
    both = cut.withColumn("_past", F.lag("_now", recent).over(order)).where("own")

    def shares(counts: Column) -> Column:
        total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x) + alpha * n_states
        return F.transform(counts, lambda x: F.greatest((x + alpha) / F.nullif(total, F.lit(0.0)), F.lit(1e-12)))

    now, past = shares(F.transform(F.arrays_zip("_now", "_past"), lambda x: x["_now"] - x["_past"])), shares(F.col("_past"))
    divergence = F.aggregate(F.zip_with(now, past, lambda p, q: p * (F.ln(p) - F.ln(q))), F.lit(0.0), lambda a, x: a + x)
    out = both.withColumn("kl", F.when(F.col("_past").isNotNull(), divergence))
    return out.select("symbol", "pos", (F.col("k") + 1).alias("n_seen"), "kl", F.coalesce(F.col("kl") >= threshold, F.lit(False)).alias("alert"))
