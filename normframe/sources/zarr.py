"""Zarr arrays of two dimensions: read chunk by chunk, and written by the tasks that hold the chunks.

The array is a Spark data source. Its partitions are computed from the chunk
grid, so nothing is listed, and a rectangle opens the files of its own chunks:
the bounds come as options, or as filters on ci and cj where the session pushes
filters into Python sources. In a sharded file the index and the wanted chunks
are read, not the rest. Stores that Arrow can't open (Spark's own views, for
one) are read by Spark's binary files, by name for small rectangles.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..functions.numeric import NAN
from .chunks import ChunkedMatrix, Span, to_chunks
from .storage import qualified, read_file

#: Bytes of values that a read task takes (more if there were over MOST_TASKS of them), and chunk files that are asked for by name where Spark lists them.
TASK_BYTES, MOST_TASKS, NAMED_FILES = 64 << 20, 20_000, 1000


#: In a shard's index: a chunk that is not there.
ABSENT = (1 << 64) - 1


@dataclass(frozen=True)
class _Format:
    """How the files of an array hold its chunks. ``shard``: chunks of one file by rows and columns, with an index in the file."""

    shape: tuple[int, int]
    chunk: tuple[int, int]
    fill: float
    kind: str
    order: str
    codecs: tuple[str, ...]
    shard: tuple[int, int] | None = None
    index_first: bool = False
    index_checked: bool = False
    start: str = ""
    separator: str = "."

    def name(self, i: int, j: int) -> str:
        """A chunk file's path within the array."""
        return f"{self.start}{i}{self.separator}{j}"

    @property
    def tail(self) -> str:
        """The end of a chunk file's path, with its two numbers, as a pattern."""
        literal = lambda x: x.replace(".", "[.]")
        return rf"/{literal(self.start)}(\d+){literal(self.separator)}(\d+)$"

    def index_at(self, size: int) -> tuple[int, int]:
        """Where the index of a shard of ``size`` bytes starts, and its length without a checksum."""
        entries = 16 * (self.shard[0] * self.shard[1] if self.shard else 0)
        return (0 if self.index_first else size - entries - 4 * self.index_checked), entries


def _where(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a qualified path, and the path there. Raises where Arrow has none."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def _decode(data: bytes, how: _Format) -> np.ndarray:
    x = np.frombuffer(_unpack(data, how.codecs), how.kind).astype(float)
    return x.reshape(how.chunk[::-1]).T.ravel() if how.order == "F" else x


class _Rows:
    """Chunks as record batches."""

    def __init__(self, how: _Format):
        self.how, self.size = how, how.chunk[0] * how.chunk[1]

    def batch(self, ci: int, cj: int, x: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array([0, self.size], pa.int32()), pa.array(x))
        return pa.RecordBatch.from_arrays([pa.array([ci]), pa.array([cj]), lists], ["ci", "cj", "values"])


@dataclass
class ChunkFiles(InputPartition):
    """A rectangle of files: part of one row of files, or whole rows of small ones."""

    rows: Span
    cols: Span


class ZarrReader(DataSourceReader):
    """Reads the chunks in a rectangle of chunk numbers; absent chunks come filled."""

    def __init__(self, uri: str, how: _Format, tall: Span, across: Span):
        self.uri, self.how, self.tall, self.across = uri, how, tall, across

    def partitions(self) -> list[ChunkFiles]:
        per = self.how.shard or (1, 1)
        rows, cols = ((low // n, -(-high // n)) if low < high else (0, 0) for (low, high), n in zip((self.tall, self.across), per, strict=True))
        each = 8 * per[0] * per[1] * self.how.chunk[0] * self.how.chunk[1]
        files = (rows[1] - rows[0]) * (cols[1] - cols[0])
        most = max(1, max(TASK_BYTES, files * each // MOST_TASKS) // each)
        wide = min(most, max(1, cols[1] - cols[0]))
        tall = max(1, most // wide) if wide == cols[1] - cols[0] else 1
        return [ChunkFiles((i, min(i + tall, rows[1])), (j, min(j + wide, cols[1]))) for i in range(*rows, tall) for j in range(*cols, wide)]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, ChunkFiles):  # Spark asks once where there are no partitions
            return
        fs, root = _where(self.uri)
        rows, empty = _Rows(self.how), np.full(self.how.chunk[0] * self.how.chunk[1], self.how.fill)
        for i in range(*partition.rows):
            for j in range(*partition.cols):
                for ci, cj, data in self._file(fs, f"{root}/{self.how.name(i, j)}", i, j):
                    yield rows.batch(ci, cj, empty if data is None else _decode(data, self.how))

    def _file(self, fs: pafs.FileSystem, path: str, i: int, j: int) -> Iterator[tuple[int, int, bytes | None]]:
        """The chunks of a file that lie in the rectangle; None for absent ones."""
        per = self.how.shard or (1, 1)
        wanted = [(a, b) for a in range(i * per[0], (i + 1) * per[0]) if self.tall[0] <= a < self.tall[1] for b in range(j * per[1], (j + 1) * per[1]) if self.across[0] <= b < self.across[1]]
        try:
            file = fs.open_input_file(path)
        except FileNotFoundError:
            yield from ((a, b, None) for a, b in wanted)
            return
        with file:
            if self.how.shard is None:
                yield i, j, file.read()
                return
            start, size = self.how.index_at(file.size())
            index = np.frombuffer(file.read_at(size, start), "<u8").reshape(*per, 2)
            for a, b in wanted:
                at, length = index[a - i * per[0], b - j * per[1]].tolist()
                yield a, b, None if at == ABSENT else file.read_at(length, at)


class PushingZarrReader(ZarrReader):
    """The same with comparisons of ci and cj pushed into it."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            value = getattr(f, "value", None)
            column = getattr(f, "attribute", ())
            if column not in (("ci",), ("cj",)) or not isinstance(value, int) or not self._narrow(column[0], f, value):
                yield f

    def _narrow(self, column: str, f: Filter, value: int) -> bool:
        bounds = {EqualTo: (value, value + 1), GreaterThan: (value + 1, None), GreaterThanOrEqual: (value, None), LessThan: (None, value), LessThanOrEqual: (None, value + 1)}.get(type(f))
        if bounds is None:
            return False
        name = "tall" if column == "ci" else "across"
        low, high = getattr(self, name)
        low, high = max(low, low if bounds[0] is None else bounds[0]), min(high, high if bounds[1] is None else bounds[1])
        setattr(self, name, (low, max(low, high)))
        return True


class ZarrWriter(DataSourceArrowWriter):
    """Writes chunk rows as files. A file is complete or absent, and the same whichever attempt of a task writes it; the metadata comes last."""

    def __init__(self, uri: str, how: _Format, metadata: str):
        self.uri, self.how, self.metadata = uri, how, metadata

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _where(self.uri)
        local = isinstance(fs, pafs.LocalFileSystem)
        for batch in iterator:
            columns = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            for ci, cj, x in zip(columns["ci"].to_pylist(), columns["cj"].to_pylist(), columns["values"], strict=True):
                path = f"{root}/{self.how.name(ci, cj)}"
                fs.create_dir(os.path.dirname(path), recursive=True)
                data = zlib.compress(x.values.to_numpy(zero_copy_only=False).astype(self.how.kind).tobytes(), level=1, wbits=31)
                draft = f"{path}.{uuid.uuid4().hex}" if local else path  # object stores show whole files only
                with fs.open_output_stream(draft) as out:
                    out.write(data)
                if local:
                    fs.move(draft, path)
        return WriterCommitMessage()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _where(self.uri)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/zarr.json") as out:
            out.write(self.metadata.encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Without metadata the chunk files are no array, and the next attempt writes over them."""


class ZarrSource(DataSource):
    """Chunks (ci, cj, values) of one array."""

    @classmethod
    def name(cls) -> str:
        return "normframe_zarr"

    def schema(self) -> str:
        return "ci bigint, cj bigint, values array<double>"

    def _how(self) -> _Format:
        return _Format(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(self.options["how"]).items()})

    def reader(self, schema: Any) -> DataSourceReader:
        o = self.options
        kind = PushingZarrReader if o.get("push") == "true" else ZarrReader
        return kind(o["uri"], self._how(), tuple(json.loads(o["tall"])), tuple(json.loads(o["across"])))

    def writer(self, schema: Any, overwrite: bool) -> DataSourceArrowWriter:
        return ZarrWriter(self.options["uri"], self._how(), self.options["metadata"])


def read_zarr(spark: SparkSession, path: str) -> ChunkedMatrix:
    """A two-dimensional Zarr array of 32- or 64-bit floats: formats 2 and 3; raw, gzip, zlib or zstd chunks, sharded or not.

    A sharded array's chunks are the inner ones. Values are not converted beyond doubles.
    """
    how, uri = _format(spark, path), qualified(spark, path)
    try:
        _where(uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ImportError):
        return ChunkedMatrix(_listed(spark, path, how), how.shape, how.chunk, how.fill)
    return ChunkedMatrix(zarr_chunks(spark, uri, how), how.shape, how.chunk, how.fill, complete=True)


def zarr_chunks(spark: SparkSession, uri: str, how: _Format) -> Callable[[Span, Span], DataFrame]:
    """Chunks of a rectangle of chunk numbers from the data source."""
    spark.dataSource.register(ZarrSource)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")

    @lru_cache(64)
    def near(tall: Span, across: Span) -> DataFrame:
        reader = spark.read.format(ZarrSource.name()).option("uri", uri).option("how", json.dumps(asdict(how))).option("push", push)
        return reader.option("tall", json.dumps(tall)).option("across", json.dumps(across)).load()

    return near


def _listed(spark: SparkSession, path: str, how: _Format) -> Callable[[Span, Span], DataFrame]:
    """The same from Spark's binary files: of a small rectangle the files that are there, by name; else all, and a filter on their names."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, (tall, across) = _Rows(how), how.shard or (1, 1)
        for batch in batches:
            for ci, cj, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for di, dj, data in _parts(blob, how):
                    yield rows.batch(ci * tall + di, cj * across + dj, _decode(data, how))

    def near(tall: Span, across: Span) -> DataFrame:
        per = how.shard or (1, 1)
        spans = [(low // n, -(-high // n)) if low < high else (0, 0) for (low, high), n in zip((tall, across), per, strict=True)]
        reader, numbers = spark.read.format("binaryFile"), [(i, j) for i in range(*spans[0]) for j in range(*spans[1])] if (spans[0][1] - spans[0][0]) * (spans[1][1] - spans[1][0]) <= NAMED_FILES else None
        if numbers is None:
            files = reader.option("recursiveFileLookup", "true").load(path)
        else:
            there = [n for n in (f"{path}/{how.name(i, j)}" for i, j in numbers) if _exists(spark, n)]
            files = reader.load(there) if there else spark.createDataFrame([], "path string, content binary")
        named = files.select(*[F.regexp_extract("path", how.tail, k).alias(n) for k, n in ((1, "ci"), (2, "cj"))], "content").filter("ci != ''")
        found = named.select(F.col("ci").cast("long").alias("ci"), F.col("cj").cast("long").alias("cj"), "content")
        found = found.filter(F.col("ci").between(spans[0][0], spans[0][1] - 1) & F.col("cj").between(spans[1][0], spans[1][1] - 1))
        return found.mapInArrow(decode, "ci bigint, cj bigint, values array<double>").filter(
            F.col("ci").between(tall[0], tall[1] - 1) & F.col("cj").between(across[0], across[1] - 1)
        )

    return near


def write_zarr(matrix: Any, path: str, nrows: int, chunk: Span, fill: float = 0.0, row_of: str | None = None, size: str = "float64") -> None:
    """Write a dense matrix with row numbers as keys as a Zarr array of format 3 with gzipped chunks; chunks of fill values are left out.

    Tasks write the files of the chunks they hold; the metadata is written when all are there.
    """
    spark = matrix.dense().df.sparkSession
    uri = qualified(spark, path)
    value: Any = float(fill) if np.isfinite(fill) else {np.inf: "Infinity", -np.inf: "-Infinity"}.get(fill, "NaN")
    metadata = {
        "zarr_format": 3, "node_type": "array", "shape": [nrows, matrix.ncols], "data_type": size, "fill_value": value,
        "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "gzip", "configuration": {"level": 1}}],
        "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(chunk)}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}},
    }
    spark.dataSource.register(ZarrSource)
    writer = to_chunks(matrix, chunk, fill, row_of).write.format(ZarrSource.name()).mode("append").option("uri", uri)
    writer.option("how", json.dumps(asdict(_version3(metadata)))).option("metadata", json.dumps(metadata)).save()


def _parts(blob: bytes, how: _Format) -> Iterator[tuple[int, int, bytes]]:
    """The chunks in a whole file: the file itself, or what the index of a shard lists; absent ones are left out."""
    if how.shard is None:
        yield 0, 0, blob
        return
    start, size = how.index_at(len(blob))
    for k, (at, length) in enumerate(np.frombuffer(blob[start : start + size], "<u8").reshape(-1, 2).tolist()):
        if at != ABSENT:
            yield k // how.shard[1], k % how.shard[1], blob[at : at + length]


def _exists(spark: SparkSession, path: str) -> bool:
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(name)


def _format(spark: SparkSession, path: str) -> _Format:
    if (text := read_file(spark, f"{path}/zarr.json")) is not None:
        out = _version3(json.loads(text))
    elif (text := read_file(spark, f"{path}/.zarray")) is not None:
        out = _version2(json.loads(text))
    else:
        raise ValueError(f"{path} holds no array metadata")
    if len(out.shape) != 2:
        raise ValueError("the array does not have two dimensions")
    return out


def _version2(m: dict[str, Any]) -> _Format:
    packed = (m.get("compressor") or {}).get("id")
    if m["dtype"] not in ("<f4", "<f8", ">f4", ">f8") or packed not in (None, "zlib", "gzip", "zstd") or m.get("filters"):
        raise ValueError(f"the array's type, compressor or filters are not supported: {m['dtype']}, {packed}, {m.get('filters')}")
    return _Format(
        tuple(m["shape"]), tuple(m["chunks"]), _fill(m["fill_value"]), m["dtype"], m["order"], (packed,) if packed else (), separator=m.get("dimension_separator", ".")
    )


def _version3(m: dict[str, Any]) -> _Format:
    encoding = m.get("chunk_key_encoding", {"name": "default"})
    by_default = encoding["name"] == "default"
    separator = encoding.get("configuration", {}).get("separator", "/" if by_default else ".")
    prefix = f"c{separator}" if by_default else ""
    chunk, codecs = tuple(m["chunk_grid"]["configuration"]["chunk_shape"]), m["codecs"]
    shard, first, checked = None, False, False
    if codecs[0]["name"] == "sharding_indexed" and len(codecs) == 1:
        inner = codecs[0]["configuration"]
        first = inner.get("index_location", "end") == "start"
        steps = [c["name"] for c in inner.get("index_codecs", [])]
        if steps not in (["bytes"], ["bytes", "crc32c"]):
            raise ValueError(f"the shard index's codecs are not supported: {steps}")
        checked = "crc32c" in steps
        shard = tuple(a // b for a, b in zip(chunk, inner["chunk_shape"], strict=True))
        chunk, codecs = tuple(inner["chunk_shape"]), inner["codecs"]
    size = {"float32": "f4", "float64": "f8"}.get(m["data_type"])
    unknown = {c["name"] for c in codecs} - {"bytes", "gzip", "zstd", "crc32c"}
    if size is None or unknown:
        raise ValueError(f"the array's type or codecs are not supported: {m['data_type']}, {sorted(unknown)}")
    end = next((c.get("configuration", {}).get("endian", "little") for c in codecs if c["name"] == "bytes"), "little")
    kind = ("<" if end == "little" else ">") + size
    return _Format(tuple(m["shape"]), chunk, _fill(m["fill_value"]), kind, "C", tuple(c["name"] for c in codecs if c["name"] != "bytes"), shard, first, checked, prefix, separator)


def _fill(value: Any) -> float:
    """The fill value; a string of hexadecimal digits is the number's bits."""
    if isinstance(value, str) and value.startswith("0x"):
        bits = bytes.fromhex(value[2:])
        return float(np.frombuffer(bits, f">f{len(bits)}")[0])
    names = {"NaN": NAN, "Infinity": float("inf"), "-Infinity": float("-inf"), None: 0.0}
    return names[value] if value is None or isinstance(value, str) else float(value)


def _unpack(data: bytes, codecs: tuple[str, ...]) -> bytes:
    """A chunk's raw bytes: its codecs undone from the last to the first."""
    for name in reversed(codecs):
        if name == "zstd":
            import zstandard

            data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
        elif name == "crc32c":
            data = data[:-4]
        else:
            data = zlib.decompress(data, 47)
    return data
