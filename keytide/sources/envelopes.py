"""Trace dumps whose traces all lie in one JSON document, read trace by trace.

Spark's JSON reader holds a document of many lines as a whole, and an export of hundreds of thousands of
traces is one document. This source goes through it piece by piece and gives out each
trace as it ends, so a task holds a piece and the largest trace. Files are read in parallel,
by Arrow's file systems (local paths, and the stores that Arrow knows by their scheme).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

NAME = "trace_envelopes"
# Characters read at once, and traces that go to Spark together.
PIECE, BATCH = 1 << 20, 1_024
# Fixed value: the field of the document under which its traces are.
LIST_START = re.compile(r'"data"\s*:\s*\[')
BETWEEN = re.compile(r"[\s,]*")


def traces_in(text: Iterator[str]) -> Iterator[dict]:
    """The traces of documents ``{"data": [trace, ...]}`` that follow each other, as each one ends.

    ``text`` comes in pieces cut anywhere. A list of traces must be whole; what surrounds it is not
    looked at.
    """
    decode = json.JSONDecoder().raw_decode
    buffer, at, inside, ended = "", 0, False, False
    while True:
        if not inside:
            start = LIST_START.search(buffer, at)
            if start:
                inside, at = True, start.end()
        if inside:
            at = BETWEEN.match(buffer, at).end()
            if buffer.startswith("]", at):
                inside, at = False, at + 1
                continue
            if at < len(buffer):
                try:
                    trace, at = decode(buffer, at)
                    yield trace
                    continue
                except json.JSONDecodeError:
                    if ended:
                        raise ValueError("a trace is cut off or not JSON") from None
        if ended:
            if inside:
                raise ValueError("the list of traces does not end")
            return
        # what is left is part of one trace; outside a list only a cut-off field name matters
        buffer, at = (buffer[at:] if inside else buffer[at:][-64:]), 0
        # twice as much each time, so that a long trace is not tried over and over
        wanted, got = max(PIECE, len(buffer)), []
        while wanted > 0 and not ended:
            piece = next(text, None)
            if piece is None:
                ended = True
            else:
                got.append(piece)
                wanted -= len(piece)
        buffer += "".join(got)


def _shaped(value, kind: T.DataType):
    """A JSON value as Spark's JSON reader gives it for a type: unfit values are NULL."""
    if isinstance(kind, T.StructType):
        return {f.name: _shaped(value.get(f.name), f.dataType) for f in kind} if isinstance(value, dict) else None
    if isinstance(kind, T.ArrayType):
        return [_shaped(v, kind.elementType) for v in value] if isinstance(value, list) else None
    if isinstance(kind, T.MapType):
        return [(k, _shaped(v, kind.valueType)) for k, v in value.items()] if isinstance(value, dict) else None
    if isinstance(kind, T.StringType):
        return value if value is None or isinstance(value, str) else json.dumps(value, separators=(",", ":"))
    whole = isinstance(value, int) and not isinstance(value, bool)
    return value if whole else None


def _within(trace: dict, service: str | None, since: int | None) -> bool:
    spans = trace["spans"] or []
    if service is not None:
        names = dict(trace["processes"] or [])
        if not any(s and (names.get(s["processID"]) or {}).get("serviceName") == service for s in spans):
            return False
    return since is None or any(s and s["startTime"] is not None and s["startTime"] >= since for s in spans)


class OneFile(InputPartition):
    def __init__(self, uri: str):
        super().__init__(uri)
        self.uri = uri


class EnvelopeReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema = schema
        self.path = options["path"]
        self.service = options.get("service")
        self.since = int(options["since"]) if "since" in options else None

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = _located(self.path)
        found = store.get_file_info(root)
        if found.type == fs.FileType.File:
            return [OneFile(self.path)]
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = store.get_file_info(fs.FileSelector(root, recursive=True))
        hidden = lambda f: any(p.startswith(("_", ".")) for p in f.path[len(root) :].split("/"))
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
        return [OneFile(scheme + f.path) for f in files if f.type == fs.FileType.File and not hidden(f)]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        arrow, rows = to_arrow_schema(self.schema), []
        for trace in traces_in(_pieces(partition.uri)):
            shaped = _shaped(trace, self.schema)
            if shaped is None or not _within(shaped, self.service, self.since):
                continue
            rows.append(shaped)
            if len(rows) == BATCH:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)


class TraceEnvelopes(DataSource):
    """``spark.read.format("trace_envelopes").option("service", ...).option("since", ...).load(path)``;
    ``since`` is in microseconds. Traces that the options exclude don't leave the reader."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        from keytide.sources.traces import TRACE_SCHEMA

        return TRACE_SCHEMA

    def reader(self, schema: T.StructType) -> EnvelopeReader:
        return EnvelopeReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TraceEnvelopes)


def _located(path: str):
    """Arrow's file system for a path, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _pieces(uri: str) -> Iterator[str]:
    """A file's text; a character cut in two is put together."""
    import codecs

    store, path = _located(uri)
    decoder = codecs.getincrementaldecoder("utf-8-sig")(errors="replace")
    with store.open_input_stream(path) as stream:
        while piece := stream.read(PIECE):
            yield decoder.decode(piece)
    yield decoder.decode(b"", final=True)
