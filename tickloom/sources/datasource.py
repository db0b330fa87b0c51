"""Spark data sources in Python: stored or fetched responses, and a channel of the newest alerts.

``register(spark)`` makes them known; then

* ``spark.read.format("responses")`` gives symbol, date, response, error. Its option ``path`` is a folder
  of symbol=<symbol>/<date>.json files, or ``urls`` a template with {symbol} and {date}, for the symbols
  and dates of the options of these names, which ``opener`` (module:function) fetches, with tries. A
  partition is a symbol; filters on symbol and date leave out partitions and files before anything is
  read. Decoders of ``market`` take it from there.
* ``spark.readStream.format("responses")`` gives files as they come: an offset is how far a listing in
  order of dates and symbols has come, so a restart goes on after the last committed one.
* ``df.writeStream.format("alerts")`` keeps, at ``path``, one file an epoch with the ``most`` (20) newest of all
  alerts(id, ts, ..) so far, or a heartbeat and these where the epoch had none. A task sends no more
  than ``most`` rows to the driver. An epoch that is committed again after a restart is computed from
  the same epoch before it, so it has the same content.

Paths are those of pyarrow.fs: local folders or URIs.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from tickloom.session import workers_import

SCHEMA = "symbol string, date string, response string, error string"


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, str, str]]:
    """(date, symbol, file) of all stored responses, in that order."""
    from pyarrow import fs

    store, root = _fs(path)
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    out = []
    for f in found:
        folder = f.path.rsplit("/", 2)[-2]
        if f.type == fs.FileType.File and folder.startswith("symbol=") and f.base_name.endswith(".json"):
            out.append((f.base_name.removesuffix(".json"), folder.removeprefix("symbol="), f.path))
    return sorted(out)


def _read(path: str, file: str) -> str:
    store, _ = _fs(path)
    with store.open_input_stream(file) as f:
        return f.read().decode("utf-8", "replace")


#: Which tests of a filter hold for a value; missing values pass none.
_TESTS = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


@dataclass
class Part(InputPartition):
    symbol: str
    cells: tuple  # (date, file or url)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.tests = options, []

    def pushFilters(self, filters) -> Iterator:
        """Keep tests of symbol and date by plain comparisons; the others are Spark's."""
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("symbol",), ("date",)):
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def _passes(self, name: str, value: str) -> bool:
        return all(_TESTS[kind](value, wanted) for n, kind, wanted in self.tests if n == name)

    def partitions(self) -> list[InputPartition]:
        by: dict[str, list] = {}
        if "path" in self.options:
            cells = ((s, d, f) for d, s, f in _files(self.options["path"]))
        else:
            names = lambda k: [x.strip() for x in self.options.get(k, "").split(",") if x.strip()]
            cells = ((s, d, self.options["urls"].format(symbol=s, date=d)) for s in names("symbols") for d in names("dates"))
        for symbol, date, where in cells:
            if self._passes("symbol", symbol) and self._passes("date", date):
                by.setdefault(symbol, []).append((date, where))
        return [Part(s, tuple(sorted(c))) for s, c in sorted(by.items())]

    def read(self, partition: Part | None) -> Iterator[tuple]:
        from tickloom.sources.fetch import with_retries

        if partition is None:  # what Spark reads where there is no partition
            return
        if "path" in self.options:
            for date, file in partition.cells:
                yield partition.symbol, date, _read(self.options["path"], file), None
            return
        module, _, name = self.options["opener"].partition(":")
        get = getattr(importlib.import_module(module), name)
        least, most = float(self.options.get("least", 1.0)), float(self.options.get("most", 3.0))
        for date, url in partition.cells:
            try:
                yield partition.symbol, date, with_retries(get, url, int(self.options.get("tries", 3)), least, most), None
            except ConnectionError as e:
                yield partition.symbol, date, None, str(e)


class StreamReader(DataSourceStreamReader):
    """Files in order of dates and symbols; the offset is the last one that was given."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def initialOffset(self) -> dict:
        return {"date": "", "symbol": ""}

    def latestOffset(self) -> dict:
        found = _files(self.path)
        return {"date": found[-1][0], "symbol": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after, until = (start["date"], start["symbol"]), (end["date"], end["symbol"])
        by: dict[str, list] = {}
        for date, symbol, file in _files(self.path):
            if after < (date, symbol) <= until:
                by.setdefault(symbol, []).append((date, file))
        return [Part(s, tuple(c)) for s, c in sorted(by.items())]

    def read(self, partition: Part) -> Iterator[tuple]:
        for date, file in partition.cells:
            yield partition.symbol, date, _read(self.path, file), None


class Responses(DataSource):
    @classmethod
    def name(cls) -> str:
        return "responses"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(dict(self.options))


@dataclass
class Newest(WriterCommitMessage):
    rows: list


def newest(rows: list[dict], most: int) -> list[dict]:
    """The last by time and id, each id once."""
    by = {r["id"]: r for r in sorted(rows, key=lambda r: (r["ts"], r["id"]))}
    return sorted(by.values(), key=lambda r: (r["ts"], r["id"]), reverse=True)[:most]


class AlertWriter(DataSourceStreamWriter):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("most", 20))

    def write(self, rows) -> Newest:
        own: list[dict] = []
        for r in rows:
            if r["id"] is None or r["ts"] is None:  # a tick of the clock
                continue
            own.append({k: v if v is None or isinstance(v, (int, float, str, bool)) else v.isoformat() for k, v in r.asDict().items()})
            if len(own) > 50 * self.most:
                own = newest(own, self.most)
        return Newest(newest(own, self.most))

    def _epoch(self, k: int) -> list[dict]:
        from pyarrow import fs

        store, root = _fs(self.path)
        if k < 0 or store.get_file_info(f"{root}/{k}.json").type == fs.FileType.NotFound:
            return []
        return json.loads(_read(self.path, f"{root}/{k}.json"))["newest"]

    def commit(self, messages, batchId: int) -> None:
        """One file an epoch, written aside and moved: it is there whole or not at all."""
        own = [r for m in messages if m is not None for r in m.rows]
        store, root = _fs(self.path)
        store.create_dir(root, recursive=True)
        body = {"epoch": batchId, "heartbeat": not own, "newest": newest(own + self._epoch(batchId - 1), self.most)}
        with store.open_output_stream(f"{root}/{batchId}.tmp") as f:
            f.write(json.dumps(body, ensure_ascii=False).encode())
        store.move(f"{root}/{batchId}.tmp", f"{root}/{batchId}.json")

    def abort(self, messages, batchId: int) -> None:
        """Nothing was written."""


class Alerts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "alerts"

    def streamWriter(self, schema, overwrite) -> AlertWriter:
        return AlertWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    workers_import(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Responses)
    spark.dataSource.register(Alerts)


def push_newest(alerts, path: str, checkpoint: str, most: int = 20, every: str = "5 seconds"):
    """A running query that writes the newest of all alerts(id, ts, ..) at every trigger, or a heartbeat
    where none came: a clock's ticks keep its epochs going."""
    from pyspark.sql import functions as F

    spark = alerts.sparkSession
    register(spark)
    own = alerts.withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    ticks = clock.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in own.schema.fields])
    return own.unionByName(ticks).writeStream.format("alerts").option("path", path).option("most", most).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
