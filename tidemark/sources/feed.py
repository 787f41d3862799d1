"""Python data sources: price history by ticker, in batch, and a quote feed, as a stream.

History: a partition a ticker. Filters on ticker and date are pushed down: tickers that a query doesn't ask for are no
partitions, dates reach the fetch. A ticker that can't be fetched is a row with `error`, not a failed job.

Quote feed: a log of numbered segments, each published as a whole. An offset is the number of the last segment read, so a
query that restarts from its checkpoint replays exactly the segments of the batch it was in. Row groups are partitions.

Both read files through pyarrow's file systems, in the tasks; another vendor is a subclass with fetch() of its own.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

PRICES = ("open", "high", "low", "close")
#: Fixed value: characters that Spark writes as % and two hex digits in the name of a partition's folder.
ESCAPED = "\"#%'*/:=?\\\x7f{[]^"


def folder(ticker: str) -> str:
    """The name of a ticker's folder under partitionBy("ticker")."""
    return "ticker=" + "".join(f"%{ord(c):02X}" if c in ESCAPED or c < " " else c for c in ticker)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Ticker(InputPartition):
    ticker: str
    first: dt.date | None
    last: dt.date | None


class HistoryReader(DataSourceReader):
    def __init__(self, source: History):
        self.source = source
        self.tickers: list[str] = json.loads(source.options["tickers"])
        day = lambda k: dt.date.fromisoformat(source.options[k]) if source.options.get(k) else None
        self.first, self.last = day("first"), day("last")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            at = f.attribute if hasattr(f, "attribute") else ()
            if at == ("ticker",) and isinstance(f, EqualTo | In):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.tickers = [t for t in self.tickers if t in wanted]
                continue
            if at == ("date",):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.first = max(self.first or f.value, f.value)
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.last = min(self.last or f.value, f.value)
            yield f  # dates are fetched with both ends, and errors have none: Spark filters again

    def partitions(self) -> list[Ticker]:
        return [Ticker(t, self.first, self.last) for t in dict.fromkeys(self.tickers)]

    def read(self, partition: Ticker) -> Iterator[pa.RecordBatch]:
        """Normalised bars. What fails before the first bar is tried again, then reported; what fails later fails the task, which Spark runs again."""
        attempts, error = int(self.source.options.get("attempts", "3")), "no data"
        for _ in range(attempts):
            n = 0
            try:
                for b in self.source.fetch(partition.ticker, partition.first, partition.last):
                    out = normalised(b, partition.ticker)
                    if out.num_rows:
                        n += out.num_rows
                        yield out
                error = "no data"
                break
            except Exception as e:
                if n:
                    raise
                error = f"{type(e).__name__}: {e}"[:500]
        if not n:
            yield pa.RecordBatch.from_pylist([{"ticker": partition.ticker, "error": error}], BARS)


#: Columns of the history source.
BARS = pa.schema([("date", pa.date32()), ("ticker", pa.string()), *((c, pa.float64()) for c in PRICES), ("volume", pa.int64()), ("error", pa.string())])


def normalised(b: pa.RecordBatch, ticker: str) -> pa.RecordBatch:
    """Bars under lower-case names, open to volume alone; the day without time or zone; rows without any price dropped, volume 0 where it is null."""
    of = {n.strip().lower().replace(" ", "_"): b.column(i) for i, n in enumerate(b.schema.names)}
    n = b.num_rows
    day = of["date"]
    if pa.types.is_string(day.type) or pa.types.is_large_string(day.type):
        day = pc.strptime(pc.utf8_slice_codeunits(day, 0, 10), "%Y-%m-%d", "s")
    elif pa.types.is_timestamp(day.type) and day.type.tz:
        day = pc.local_timestamp(day)
    cols = {c: of[c].cast(pa.float64()) if c in of else pa.nulls(n, pa.float64()) for c in PRICES}
    volume = pc.fill_null(of["volume"].cast(pa.int64(), safe=False), 0) if "volume" in of else pa.array([0] * n, pa.int64())
    out = pa.RecordBatch.from_arrays([day.cast(pa.date32()), pa.array([ticker] * n, pa.string()), *cols.values(), volume, pa.nulls(n, pa.string())], schema=BARS)
    priced = [pc.is_valid(c) for c in cols.values()]
    return out.filter(pc.or_(pc.or_(priced[0], priced[1]), pc.or_(priced[2], priced[3])))


class History(DataSource):
    """Options: path (a folder of Parquet files a ticker), tickers (a JSON list), first and last (days, both included), attempts."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_history"

    def schema(self) -> str:
        return "date date, ticker string, open double, high double, low double, close double, volume long, error string"

    def reader(self, schema) -> HistoryReader:
        return HistoryReader(self)

    def fetch(self, ticker: str, first: dt.date | None, last: dt.date | None) -> Iterator[pa.RecordBatch]:
        """A ticker's bars as the vendor has them, at least those from first to last."""
        system, root = file_system(self.options["path"])
        data = ds.dataset(f"{root.rstrip('/')}/{folder(ticker)}", filesystem=system, format="parquet")
        (name,) = [n for n in data.schema.names if n.strip().lower() == "date"]
        test = None
        if pa.types.is_date(data.schema.field(name).type):
            for part in ((ds.field(name) >= first) if first else None, (ds.field(name) <= last) if last else None):
                test = part if test is None else test if part is None else test & part
        yield from data.to_batches(filter=test)


def history(spark: SparkSession, path: str, tickers: list[str], first: str = "", last: str = "", source: type[History] = History) -> DataFrame:
    """Bars of the tickers, and a row with `error` (and no date) for each that has none."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    options = {"path": path, "tickers": json.dumps(tickers), "first": first, "last": last}
    return spark.read.format(source.name()).options(**{k: v for k, v in options.items() if v}).load()


def report(bars: DataFrame) -> DataFrame:
    """(ticker, bars, failed, error) of history()."""
    out = bars.groupBy("ticker").agg(F.count("date").alias("bars"), F.max("error").alias("error"))
    return out.select("ticker", "bars", F.col("error").isNotNull().alias("failed"), "error")


def publish(rows: DataFrame, path: str, number: int) -> None:
    """Writes rows as the feed's segment of that number (from 1, without gaps); it is there for readers once it is whole."""
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{number:012d}")


@dataclass
class RowGroup(InputPartition):
    path: str
    group: int


class QuoteReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], names: list[str]):
        self.options, self.names = options, names

    def _root(self) -> tuple[fs.FileSystem, str]:
        system, root = file_system(self.options["path"])
        return system, root.rstrip("/")

    def initialOffset(self) -> dict:
        return {"segment": int(self.options.get("after", "0"))}

    def latestOffset(self) -> dict:
        """The last of the whole segments that follow one another."""
        system, root = self._root()
        there = {i.base_name for i in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.base_name.isdigit()}
        n = self.initialOffset()["segment"]
        whole = lambda k: system.get_file_info(f"{root}/{k:012d}/_SUCCESS").type == fs.FileType.File
        if there and n < int(min(there)):
            n = int(min(there)) - 1  # older ones have been dropped
        while f"{n + 1:012d}" in there and whole(n + 1):
            n += 1
        return {"segment": n}

    def partitions(self, start: dict, end: dict) -> list[RowGroup]:
        system, root = self._root()
        out = []
        for n in range(start["segment"] + 1, end["segment"] + 1):
            for i in sorted(system.get_file_info(fs.FileSelector(f"{root}/{n:012d}")), key=lambda i: i.path):
                if i.base_name.endswith(".parquet"):
                    out += [RowGroup(i.path, g) for g in range(pq.ParquetFile(system.open_input_file(i.path)).num_row_groups)]
        return out

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        system, _ = self._root()
        file = pq.ParquetFile(system.open_input_file(partition.path), coerce_int96_timestamp_unit="us")
        for b in file.iter_batches(row_groups=[partition.group], columns=self.names):
            yield b.select(self.names).cast(pa.schema([QUOTES.field(n) for n in self.names]))

    def commit(self, end: dict) -> None:
        """With the option consumer: notes how far it has come, for whoever drops old segments."""
        if consumer := self.options.get("consumer"):
            system, root = self._root()
            system.create_dir(f"{root}/_consumers")
            with system.open_output_stream(f"{root}/_consumers/{consumer}.new") as out:
                out.write(json.dumps(end).encode())
            system.move(f"{root}/_consumers/{consumer}.new", f"{root}/_consumers/{consumer}")


#: Columns of the quote feed.
QUOTES = pa.schema([("event_id", pa.int64()), ("time", pa.timestamp("us", "UTC")), ("symbol", pa.string()), ("bid", pa.float64()), ("ask", pa.float64())])


class QuoteFeed(DataSource):
    """Options: path (the segments' folder), after (the number of the last segment not wanted), consumer (a name for commit())."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_quotes"

    def schema(self) -> str:
        return "event_id long, time timestamp, symbol string, bid double, ask double"

    def streamReader(self, schema) -> QuoteReader:
        return QuoteReader(dict(self.options), schema.names)


def quotes(spark: SparkSession, path: str, consumer: str = "") -> DataFrame:
    """The feed's quotes as a stream."""
    spark.dataSource.register(QuoteFeed)
    return spark.readStream.format(QuoteFeed.name()).options(path=path, consumer=consumer).load()


def drained(stream: DataFrame, out: str, state: str) -> DataFrame:
    """Appends all that the stream has now, each row once however often it is called, to Parquet files; a scan of these."""
    stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
