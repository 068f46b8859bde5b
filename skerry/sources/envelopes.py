"""Requests of the serving interface as a Spark data source, in batches and as a stream.

Requests lie as lines of JSON in a folder for each minute, which a shared file system holds. A
minute is whole once its folder is there; a stream's offset is the last minute that it has read,
so it goes on where it stopped. Each file is read by a task.

    spark.dataSource.register(Envelopes)
    spark.read.format("envelopes").load("hdfs://.../requests")
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "minute string, id1 string, at timestamp_ntz, sys_id string, target_id string, inst_type string, kind string, time timestamp_ntz, name string, real_value double, line long, message string, error_code string"


def _time(text: object) -> datetime | None:
    try:
        return datetime.fromisoformat(text).replace(tzinfo=None) if isinstance(text, str) else None
    except ValueError:
        return None


def _number(x: object) -> float | None:
    try:
        return float(x)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None


def rows_of(minute: str, text: str) -> Iterator[tuple]:
    """One row for each measured value or log line of a request; what can't be read gives an error row."""
    try:
        request = json.loads(text)
        header, body = request["header"], request["body"]
        head = (minute, request.get("id1"), _time(request.get("standard_datetime")), *(header.get(c) for c in ("sys_id", "target_id", "inst_type")))
        items = [dict(item) for item in body]
    except (ValueError, KeyError, TypeError, AttributeError):
        yield (minute, *[None] * 11, "E703")
        return
    for item in items:
        time = _time(item.pop("time", None))
        late = "E703" if time is None else None
        if header.get("inst_type") == "log":
            line = _number(item.get("line"))
            yield (*head, "log", time, item.get("path"), None, None if line is None else int(line), item.get("log"), late)
        else:
            for name, x in item.items():
                value = _number(x)
                yield (*head, "metric", time, name, value, None, None, late or ("E703" if value is None else None))


class File(InputPartition):
    def __init__(self, minute: str, path: str) -> None:
        super().__init__(path)
        self.minute, self.path = minute, path


class _Folder:
    def __init__(self, options: dict) -> None:
        self.uri = options["path"]

    def minutes(self) -> list[str]:
        store, path = fs.FileSystem.from_uri(self.uri)
        found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == fs.FileType.Directory and f.base_name[:1] not in "._")

    def files(self, minutes: list[str]) -> list[File]:
        store, path = fs.FileSystem.from_uri(self.uri)
        found = [(m, f) for m in minutes for f in store.get_file_info(fs.FileSelector(f"{path}/{m}"))]
        return [File(m, f.path) for m, f in found if f.type == fs.FileType.File and f.base_name[:1] not in "._"]

    def read(self, partition: File | None) -> Iterator[tuple]:
        if partition is None:  # Spark's way of reading no partitions at all
            return
        store, _ = fs.FileSystem.from_uri(self.uri)
        with store.open_input_stream(partition.path) as f:
            rest = b""
            while block := f.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                for line in lines:
                    if line.strip():
                        yield from rows_of(partition.minute, line.decode("utf-8", "replace"))
            if rest.strip():
                yield from rows_of(partition.minute, rest.decode("utf-8", "replace"))


class Reader(_Folder, DataSourceReader):
    def partitions(self) -> list[File]:
        return self.files(self.minutes())


class StreamReader(_Folder, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"minute": ""}

    def latestOffset(self) -> dict:
        return {"minute": max(self.minutes(), default="")}

    def partitions(self, start: dict, end: dict) -> list[File]:
        return self.files([m for m in self.minutes() if start["minute"] < m <= end["minute"]])


class Envelopes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "envelopes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)
