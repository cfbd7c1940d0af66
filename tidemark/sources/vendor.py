"""Vendors as Spark data sources: a partition is a symbol and a range of dates.

Rows go from the vendor to the executor that asks for them; the driver only
lays out the ranges. A partition that is read again (a retried task) asks
again and yields the same numbers for the same answers.
"""

from __future__ import annotations

import datetime
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: What a vendor's row becomes; ``ingest_seq`` numbers the rows of a symbol as they came.
SCHEMA = "symbol string, date date, open double, high double, low double, close double, volume double, ingest_seq long"
VALUES = ("open", "high", "low", "close", "volume")
#: Numbers kept for the rows of one range.
RANGE_ROWS = 1 << 32
# Under which names vendors wrap their rows, in order.
WRAPPERS = ("historical", "data", "results")


def records_from(payload) -> list[dict]:
    """The rows of a vendor's JSON: the payload itself, or what the first usable wrapper holds."""
    places = [payload, *(payload.get(name) for name in WRAPPERS)] if isinstance(payload, dict) else [payload]
    rows = next((x for x in places if isinstance(x, list)), None)
    if rows is None:
        raise ValueError("no records in the payload")
    return rows


def number(value) -> float | None:
    """A finite or infinite number, null for anything else."""
    try:
        found = float(value) if value is not None and not isinstance(value, bool) else None
    except (TypeError, ValueError):
        return None
    return None if found is None or found != found else found


def typed_row(symbol: str, row: dict, seq: int) -> tuple:
    """A vendor's row under the schema; one without the price columns is an error, one without a date has a null."""
    row = {str(name).lower(): v for name, v in row.items()}
    missing = [c for c in ("date", *VALUES) if c not in row]
    if missing:
        raise ValueError(f"{symbol}: missing columns: {', '.join(missing)}")
    day = None if row["date"] is None else datetime.date.fromisoformat(str(row["date"])[:10])
    return (symbol, day, *[number(row[c]) for c in VALUES], seq)


class SymbolRange(InputPartition):
    def __init__(self, symbol: str, number: int, start: str, end: str):
        self.symbol, self.number, self.start, self.end = symbol, number, start, end


def ranges(start: str, end: str, days: int) -> list[tuple[str, str]]:
    """Ranges of at most ``days`` days from ``start`` to ``end``; one range where the dates aren't given or not dates."""
    try:
        now, last = datetime.date.fromisoformat(start), datetime.date.fromisoformat(end)
    except ValueError:
        return [(start, end)]
    out = []
    while now <= last:
        until = min(now + datetime.timedelta(days=days - 1), last)
        out.append((now.isoformat(), until.isoformat()))
        now = until + datetime.timedelta(days=1)
    return out


def vendor_source(name: str, fetch: Callable[[str, str, str], object]) -> type[DataSource]:
    """A data source ``name`` over ``fetch`` (symbol, start, end), which answers with rows or a payload that holds them.

    ``fetch`` is shipped to the executors with everything it refers to. Options:
    ``symbols`` (comma-separated), ``start``, ``end``, ``days`` (of a partition,
    3,650 unless given), ``attempts`` (3) and ``wait`` (seconds before the second, doubling).
    """

    class Reader(DataSourceReader):
        def __init__(self, options):
            names = [s.strip().upper() for s in options.get("symbols", "").split(",") if s.strip()]
            if not names:
                raise ValueError("the option symbols names none")
            self.symbols = list(dict.fromkeys(names))
            self.ranges = ranges(options.get("start", ""), options.get("end", ""), int(options.get("days", 3650)))
            self.attempts, self.wait = int(options.get("attempts", 3)), float(options.get("wait", 1.0))

        def partitions(self) -> list[SymbolRange]:
            return [SymbolRange(s, k, a, b) for s in self.symbols for k, (a, b) in enumerate(self.ranges)]

        def read(self, partition: SymbolRange) -> Iterator[tuple]:
            for attempt in range(self.attempts):
                try:
                    answer = fetch(partition.symbol, partition.start, partition.end)
                    break
                except OSError:
                    if attempt + 1 == self.attempts:
                        raise
                    time.sleep(self.wait * 2**attempt)
            for k, row in enumerate(records_from(answer)):
                yield typed_row(partition.symbol, row, partition.number * RANGE_ROWS + k)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> Reader:
            return Reader(self.options)

    return Source


def read_vendor(spark: SparkSession, name: str, fetch: Callable[[str, str, str], object], symbols: list[str], start: str, end: str, **options) -> DataFrame:
    """Typed vendor rows of the symbols, through the data source ``tidemark_<name>``."""
    source = vendor_source(f"tidemark_{name}", fetch)
    spark.dataSource.register(source)
    reader = spark.read.format(source.name()).option("symbols", ",".join(symbols)).option("start", start).option("end", end)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()
