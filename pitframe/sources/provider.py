"""Readers of providers as a Python Data Source: ``spark.read.format("provider")`` and ``spark.readStream.format("provider")``.

An adapter is what differs between sources: the columns it gives and how one payload becomes rows (``parse``). Payloads are JSON lines in files below a
folder that driver and executors share, in subfolders ``symbol=...``. A partition is a file or, of many small ones, a run of neighbours; a read leaves out the files of symbols
that a filter on ``symbol`` excludes; a stream takes new files in the order in which they came, and its offsets say how many it has taken, so that a replayed batch reads the same
files again. Users add a source by ``register`` with an adapter of their own, which may fetch its payloads in another way.
"""

from __future__ import annotations

import datetime as dt
import json
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def read_lines(path: str) -> Iterator[dict]:
    """The payloads of a file of JSON lines."""
    files, inside = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    with files.open_input_stream(inside, compression="detect") as f:
        rest = b""
        while chunk := f.read(1 << 20):
            *lines, rest = (rest + chunk).split(b"\n")
            yield from (json.loads(x) for x in lines if x.strip())
        if rest.strip():
            yield json.loads(rest)


@dataclass(frozen=True)
class Adapter:
    """``schema`` in DDL, ``parse`` from a payload to its rows, ``fetch`` from a file to its payloads.

    A payload that fails to parse is an error, unless ``strict`` is off: then it gives no rows."""

    schema: str
    parse: Callable[[dict], Iterator[tuple]]
    fetch: Callable[[str], Iterator[dict]] = read_lines
    strict: bool = True


def _time(text: str | None) -> dt.datetime | None:
    return None if text is None else dt.datetime.fromisoformat(text.replace("Z", "+00:00")).replace(tzinfo=None)


def _minutes(p: dict) -> Iterator[tuple]:
    for b in p["klines"]:
        yield p["symbol"], _time(b["time"]), int(b["event_id"]), int(p["scale"]), float(b["close"]), int(b["volume"]), _time(p["fetched_at"])


def _index_bar(source: str, currency: str | None = None) -> Callable[[dict], Iterator[tuple]]:
    def parse(p: dict) -> Iterator[tuple]:
        yield source, p["source_id"], int(p["revision"]), "INDEX", float(p["close"]), "points", currency, None

    return parse


def _announcement(p: dict) -> Iterator[tuple]:
    yield "company_announcement", p["source_id"], int(p["revision"]), "LISTED_COMPANY", None, None, None, p["content"]


def _release(p: dict) -> Iterator[tuple]:
    yield "macro_pmi_cn", p["source_id"], int(p["revision"]), "ECONOMY", float(p["value"]), "index", None, None


_RECORD = "source string, source_id string, revision int, entity_type string, value double, unit string, currency string, content string"
ADAPTERS: dict[str, Adapter] = {
    "minutes": Adapter("symbol string, event_time timestamp_ntz, event_id long, scale int, close double, volume long, available_time timestamp_ntz", _minutes),
    "cn_index_daily": Adapter(_RECORD, _index_bar("cn_index_daily")),
    "us_index_daily": Adapter(_RECORD, _index_bar("us_index_daily", "USD")),
    "company_announcement": Adapter(_RECORD, _announcement),
    "macro_pmi_cn": Adapter(_RECORD, _release),
}


@dataclass
class FilePart(InputPartition):
    paths: list[str]


    @property
    def path(self) -> str:
        return self.paths[0]


PART_BYTES, PARTS = 32 << 20, 256


def packed(files: list[tuple[str, str, int, int]]) -> list[FilePart]:
    """One partition a file up to PARTS files; of more, runs of neighbours of at most PART_BYTES (or one file), since a task costs more than a small file."""
    most = max(1, -(-len(files) // PARTS))
    out: list[FilePart] = []
    size = 0
    for path, _, _, n in files:
        if not out or len(out[-1].paths) >= most or size + n > PART_BYTES:
            out.append(FilePart([]))
            size = 0
        out[-1].paths.append(path)
        size += n
    return out


def files_below(folder: str) -> list[tuple[str, str, int, int]]:
    """(path, symbol, time, bytes) of the data files below a folder, in the order in which they came."""
    remote = "://" in folder or folder.startswith("file:")
    files, inside = fs.FileSystem.from_uri(folder) if remote else (fs.LocalFileSystem(), folder)
    scheme = folder.split("://")[0] + "://" if "://" in folder else "file:" if remote else ""
    out = []
    for f in files.get_file_info(fs.FileSelector(inside, recursive=True)):
        parts = f.path.split("/")
        if f.type == fs.FileType.File and not any(x.startswith(("_", ".")) for x in parts[len(inside.rstrip("/").split("/")) :]):
            symbol = next((x.split("=", 1)[1] for x in parts if x.startswith("symbol=")), "")
            out.append((scheme + f.path, symbol, int(f.mtime_ns or 0), int(f.size or 0)))
    return sorted(out, key=lambda x: (x[2], x[0]))


class _Rows:
    def __init__(self, folder: str, adapter: Adapter):
        self.folder, self.adapter = folder, adapter

    def read(self, partition: FilePart | None) -> Iterator[tuple]:
        for payload in (p for path in partition.paths for p in self.adapter.fetch(path)) if partition else ():  # none: a folder without files
            try:
                yield from list(self.adapter.parse(payload))
            except (KeyError, TypeError, ValueError):
                if self.adapter.strict:
                    raise


class Reader(_Rows, DataSourceReader):
    symbols: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("symbol",):
                mine = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.symbols = mine if self.symbols is None else self.symbols & mine
            yield f  # files hold one symbol each, but a payload speaks for itself: Spark checks the rows too

    def partitions(self) -> list[FilePart]:
        return packed([f for f in files_below(self.folder) if self.symbols is None or not f[1] or f[1] in self.symbols])


class StreamReader(_Rows, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(files_below(self.folder))}

    def partitions(self, start: dict, end: dict) -> list[FilePart]:
        return packed(files_below(self.folder)[start["files"] : end["files"]])


class ProviderSource(DataSource):
    """Options: path, and adapter (its name)."""

    adapters: dict[str, Adapter] = {}

    @classmethod
    def name(cls) -> str:
        return "provider"

    def _adapter(self) -> Adapter:
        found = self.adapters.get(self.options["adapter"])
        if found is None:
            raise ValueError(f"no adapter {self.options['adapter']!r}; known: {sorted(self.adapters)}")
        return found

    def schema(self) -> str:
        return self._adapter().schema

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self._adapter())

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options["path"], self._adapter())


def register(spark: SparkSession, **own: Adapter) -> None:
    """Make the format known to a session, with adapters of the caller beside the built-in ones."""
    spark.conf.set(PUSHDOWN, "true")
    for hook in (h for a in own.values() for h in (a.parse, a.fetch)):  # executors get the hooks with the query
        if hook.__module__ in sys.modules and hook.__module__ != "__main__":
            cloudpickle.register_pickle_by_value(sys.modules[hook.__module__])
    spark.dataSource.register(type("ProviderSource", (ProviderSource,), {"adapters": {**ADAPTERS, **own}}))


def write_payloads(payloads: DataFrame, path: str, folders: bool = True) -> str:
    """Payload rows as JSON lines; where they have a symbol, in a subfolder for each, unless ``folders`` is off (a stream prunes nothing, and files cost more than their lines)."""
    line = F.to_json(F.struct(*payloads.columns), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("value")
    if folders and "symbol" in payloads.columns:
        payloads.select(line, "symbol").repartition("symbol").write.mode("append").partitionBy("symbol").text(path)
    else:
        payloads.select(line).write.mode("append").text(path)
    return path
