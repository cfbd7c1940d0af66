"""Tables on disk, run logs, reports, and the registry of data providers."""

from __future__ import annotations

import datetime
import html
import json
import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.constants import ALL_SYMBOLS, FIRST_SYMBOLS
from .bars import clean_bars
from .storage import exists, filesystem, replace_file, read_file, stored
from .vendor import read_vendor, records_from  # noqa: F401

PROVIDERS: dict[str, Callable[..., list[dict]]] = {}


def provider(name: str):
    """Register a connector: (symbol, start, end) to a list of row dicts."""

    def keep(f):
        PROVIDERS[name] = f
        return f

    return keep


def download(spark: SparkSession, symbols: str | list[str], start: str, end: str, source: str, **options) -> DataFrame:
    """Bars of the symbols from a registered provider; later rows of a date win.

    The provider is read as a data source, by partitions of symbols and dates
    in parallel; the rows are stored once, so that nothing is asked for twice.
    """
    from . import connectors  # noqa: F401  registers the built-in ones

    if source not in PROVIDERS:
        raise ValueError(f"unknown provider {source}")
    rows = stored(read_vendor(spark, source, PROVIDERS[source], [symbols] if isinstance(symbols, str) else symbols, start, end, **options), "vendor-rows")
    if rows.isEmpty():
        raise ValueError("the provider returned nothing")
    return clean_bars(rows.where("date IS NOT NULL"))


def save_raw(df: DataFrame, path: str) -> None:
    """CSV with a header, a folder for each symbol."""
    df.write.mode("overwrite").option("header", True).partitionBy("symbol").csv(path)


def save_bars(df: DataFrame, path: str, source: str) -> None:
    """Parquet by provider and symbol: a reader of one symbol opens its folder alone."""
    df.withColumn("provider", F.lit(source)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("provider", "symbol").parquet(path)


def load_bars(spark: SparkSession, path: str, symbol: str | None = None, source: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if source is not None:
        df = df.where(F.col("provider") == source)
    if symbol is not None:
        df = df.where(F.col("symbol") == symbol.strip().upper())
    return df


def load_first(spark: SparkSession, path: str, symbol: str, source: str | None = None) -> DataFrame:
    """A symbol's bars from the provider's folder, else from the root without providers; an error names the places tried."""
    name = symbol.strip().upper()
    places = [f"{path}/provider={source.lower()}/symbol={name}"] if source else []
    places.append(f"{path}/symbol={name}")
    for place in places:
        if exists(spark, place):
            return spark.read.parquet(place).withColumn("symbol", F.lit(name))
    raise FileNotFoundError(f"no bars of {name}; tried {', '.join(places)}")


def symbols_in(spark: SparkSession, path: str) -> list[str]:
    """The symbols that a folder of bars holds, in order, from its partitions."""
    return [r["symbol"] for r in spark.read.parquet(path).select("symbol").distinct().orderBy("symbol").collect()]


def chosen_symbols(asked: list[str] | None = None, everything: bool = False) -> list[str]:
    """Those asked for, else the full list or the first experiment's."""
    return list(asked) if asked else list(ALL_SYMBOLS if everything else FIRST_SYMBOLS)


def newest(spark: SparkSession, pattern: str) -> str:
    """The path that the glob ``pattern`` matches with the latest change; on a tie the first by name."""
    target, fs = filesystem(spark, pattern)
    found = sorted((-s.getModificationTime(), s.getPath().toString()) for s in fs.globStatus(target) or [])
    if not found:
        raise FileNotFoundError(pattern)
    return found[0][1]


def save_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header; maps and arrays become JSON. ``single`` is for report-sized tables."""
    nested = [f.name for f in df.schema if f.dataType.typeName() in ("map", "array", "struct")]
    out = df.withColumns({c: F.to_json(c) for c in nested})
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str, required: bool = True) -> DataFrame:
    """A CSV table; if it isn't there, an error, or the empty table where it is optional."""
    if not exists(spark, path):
        if required:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).csv(path)


def append_decisions(df: DataFrame, path: str, keys: tuple[str, ...] = ("symbol", "pos", "action")) -> None:
    """Append the rows whose keys aren't there yet, so that a repeated run adds nothing."""
    spark = df.sparkSession
    if exists(spark, path):
        df = df.join(spark.read.parquet(path).select(*keys), list(keys), "left_anti")
    df.write.mode("append").parquet(path)


def _safe(value):
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {str(k): _safe(v) for k, v in value.items()}
    return [_safe(v) for v in value] if isinstance(value, list | tuple) else value


def save_json(value: dict, path: str, spark: SparkSession | None = None) -> None:
    """Write a small document in one step, on any file system that Hadoop knows: readers see the old or the new one."""
    text = json.dumps(_safe(value), indent=1, sort_keys=True, default=str)
    replace_file(spark or SparkSession.active(), path, text.encode())


def load_json(path: str, version: int | None = None, spark: SparkSession | None = None) -> dict | None:
    """The document, null if there is none; another schema version is an error."""
    found = read_file(spark or SparkSession.active(), path)
    if found is None:
        return None
    value = json.loads(found)
    if version is not None and value.get("schema_version") != version:
        raise ValueError(f"schema version {value.get('schema_version')} instead of {version}")
    return value


def slug(title: str) -> str:
    found = re.sub(r"[^a-z0-9_-]+", "-", title.strip().lower()).strip("-")
    if not found:
        raise ValueError("the title has no letters or digits")
    return found


def markdown(title: str, sections: dict[str, str]) -> str:
    return "\n".join([f"# {title}", *[f"\n## {name}\n\n{text or 'Not available.'}" for name, text in sections.items()], ""])


# An experiment report's sections, in order, and what an empty one says.
SECTIONS = (
    "Question", "Hypothesis", "Data", "State Definitions", "Model Setup", "Backtest Rules", "Results", "Benchmark Comparison",
    "What Worked", "What Failed", "Bias / Risk Checks", "Next Experiment",
)
NOT_EVALUATED = "Not evaluated in this run."


def experiment_report(name: str, sections: dict[str, str], folder: str, day: str) -> str:
    """Write the twelve sections of an experiment as Markdown; the path. Unknown sections are an error."""
    unknown = set(sections) - set(SECTIONS)
    if unknown:
        raise ValueError(f"unknown sections: {', '.join(sorted(unknown))}")
    text = markdown(f"Experiment Report: {name}", {s: sections.get(s) or NOT_EVALUATED for s in SECTIONS})
    title, rest = text.split("\n", 1)
    path = f"{folder.rstrip('/')}/{slug(name)}.md"
    replace_file(SparkSession.active(), path, f"{title}\n\n**Date:** {day}\n{rest}".encode())
    return path


def ingestion_view(status: dict | None, spark: SparkSession) -> DataFrame | str:
    """An ingestion run's rows for the dashboard, or what to say instead."""
    if status is None:
        return "No ingestion status captured yet."
    if not isinstance(status, dict) or not isinstance(status.get("symbols"), list):
        return "Could not load ingestion status: no list of symbols"
    missing = [k for k in ("provider", "start", "end", "status", "started_at") if k not in status]
    missing += [f"symbols[{i}].{k}" for i, s in enumerate(status["symbols"]) for k in ("symbol", "status") if k not in s]
    if missing:
        return f"Could not load ingestion status: missing {', '.join(missing)}"
    rows = []
    for s in status["symbols"]:
        count = next((int(s[k]) for k in ("missing_count", "total_missing") if s.get(k) is not None), 0)
        rows.append((s["symbol"], s["status"], s.get("rows"), s.get("first_date") or "n/a", s.get("last_date") or "n/a", count, s.get("error") or ""))
    kinds = "symbol string, status string, rows long, first_date string, last_date string, missing_count long, error string"
    return spark.createDataFrame(rows, kinds)


def bars_chart(rows: list[tuple[str, float | None]], title: str, limit: int = 12) -> str:
    """Horizontal bars either side of zero as SVG, of the first ``limit`` finite values."""
    kept = [(str(n), float(v)) for n, v in rows if v is not None and math.isfinite(v)][:limit]
    if not kept:
        return "<p>No chart rows available.</p>"
    top, parts = max(abs(v) for _, v in kept) or 1.0, []
    for i, (name, v) in enumerate(kept):
        width, y = 180 * abs(v) / top, 24 * i + 8
        parts.append(f'<text x="0" y="{y + 12}">{html.escape(name[:18])}</text><rect x="{340 - (width if v < 0 else 0):.1f}" y="{y}" width="{width:.1f}" height="16"/>')
        parts.append(f'<text x="{540}" y="{y + 12}">{v:.4g}</text>')
    return f'<svg viewBox="0 0 620 {24 * len(kept) + 16}" role="img"><title>{html.escape(title)}</title>{"".join(parts)}</svg>'


def dashboard(
    tables: dict[str, DataFrame | str], title: str = "Market states", rows: int = 200, charts: dict[str, tuple[str, str]] | None = None
) -> str:
    """One HTML page with report-sized tables (each a top list of at most ``rows`` rows), in the order given.

    A text in place of a table is shown as a note. ``charts`` names tables that
    get a chart: (label column, value column).
    """
    body = []
    for name, df in tables.items():
        if isinstance(df, str):
            body.append(f"<h2>{html.escape(name)}</h2><p>{html.escape(df)}</p>")
            continue
        if charts and name in charts:
            label, value = charts[name]
            body.append(bars_chart([(r[0], r[1]) for r in df.select(F.col(label).cast("string"), F.col(value).cast("double")).limit(rows).collect()], name))
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        lines = ["<tr>" + "".join(f"<td>{html.escape('' if _safe(v) is None else str(v))}</td>" for v in r) + "</tr>" for r in df.limit(rows).collect()]
        body.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{''.join(lines)}</table>")
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{''.join(body)}"


def ingest(spark: SparkSession, symbols: list[str], start: str, end: str, source: str, path: str, enrich=None) -> dict:
    """Download, enrich and save each symbol; errors are kept per symbol, and the run is success, partial or failed."""
    now = datetime.datetime.now(datetime.UTC)
    run: dict = {"run_id": f"{source}-{now:%Y%m%dT%H%M%S}", "provider": source, "start": start, "end": end, "started_at": now.isoformat(), "symbols": []}
    for symbol in symbols:
        try:
            df = download(spark, symbol, start, end, source)
            df = enrich(df) if enrich else df
            save_bars(df, path, source)
            row = df.agg(F.count(F.lit(1)), F.min("date").cast("string"), F.max("date").cast("string")).first()
            run["symbols"].append({"symbol": symbol, "status": "success", "rows": row[0], "first_date": row[1], "last_date": row[2], "error": None})
        except Exception as e:  # noqa: BLE001  one symbol's failure is a result
            run["symbols"].append({"symbol": symbol, "status": "failed", "rows": 0, "first_date": None, "last_date": None, "error": str(e)[:300]})
    good = sum(s["status"] == "success" for s in run["symbols"])
    run["finished_at"] = datetime.datetime.now(datetime.UTC).isoformat()
    run["status"] = "success" if good == len(symbols) else "partial" if good else "failed"
    return run

