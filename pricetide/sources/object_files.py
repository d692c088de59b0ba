"""Object files read and written by executors: opening, listing, and writing each key once."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from typing import Any
from uuid import uuid4

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes read at a time.
CHUNK = 1 << 20


def resolve(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or an absolute local path."""
    return pafs.FileSystem.from_uri(uri)


def chunks(uri: str) -> Iterator[bytes]:
    """The content of an object piece by piece, decompressed where its name says so."""
    fs, path = resolve(uri)
    with fs.open_input_stream(path, compression="detect") as stream:
        while piece := stream.read(CHUNK):
            yield piece


def under(uri: str, recursive: bool = True) -> list[tuple[str, pafs.FileInfo]]:
    """URIs and facts of what lies below a folder, or of one file; hidden names are left out."""
    fs, path = resolve(uri)
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.File:
        return [(uri, info)]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(uri)
    base = uri.rstrip("/")
    found = []
    for each in fs.get_file_info(pafs.FileSelector(path, recursive=recursive)):
        inner = each.path[len(path.rstrip("/")) + 1 :]
        if not any(p.startswith((".", "_")) for p in inner.split("/")):
            found.append((f"{base}/{inner}", each))
    return sorted(found, key=lambda x: x[0])


class _Prefix(InputPartition):
    def __init__(self, uri: str, deep: bool) -> None:
        self.uri, self.deep = uri, deep


class ObjectListing(DataSource):
    """Key, size, etag and time of the objects below a prefix; no body is read.

    The driver only opens `depth` levels of folders; everything below is listed by executors, a
    partition for each folder. A file system without etags of its own gets a weak one from size
    and time, which changes whenever a file is replaced.
    """

    @classmethod
    def name(cls) -> str:
        return "object_listing"

    def schema(self) -> str:
        return "key string, size bigint, etag string, modified timestamp"

    def reader(self, schema: Any) -> DataSourceReader:
        return _ListingReader(self.options["path"], int(self.options.get("depth", "1")))


class _ListingReader(DataSourceReader):
    def __init__(self, root: str, depth: int) -> None:
        self.root, self.depth = root, depth

    def partitions(self) -> list[InputPartition]:
        level, out = [self.root], [_Prefix(self.root, self.depth <= 0)]
        for at in range(1, self.depth + 1):
            level = [u for p in level for u, i in under(p, recursive=False) if i.type == pafs.FileType.Directory]
            out += [_Prefix(p, at == self.depth) for p in level]
        return out

    def read(self, partition: Any) -> Iterator[pa.RecordBatch]:
        found = [(u, i) for u, i in under(partition.uri, partition.deep) if i.type == pafs.FileType.File]
        base = len(self.root.rstrip("/")) + 1
        tags = [hashlib.md5(f"{i.size}-{i.mtime_ns}".encode()).hexdigest() for _, i in found]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([u[base:] for u, _ in found], pa.string()),
                pa.array([i.size for _, i in found], pa.int64()),
                pa.array([f'W/"{t}"' for t in tags], pa.string()),
                pa.array([i.mtime_ns // 1000 if i.mtime_ns else None for _, i in found], pa.timestamp("us", "UTC")),
            ],
            names=["key", "size", "etag", "modified"],
        )


def list_objects(spark: SparkSession, root: str, depth: int = 1) -> DataFrame:
    """The objects below `root`, listed by executors: key, size, etag, modified."""
    spark.dataSource.register(ObjectListing)
    return spark.read.format("object_listing").option("path", root).option("depth", str(depth)).load()


def dealt(rows: DataFrame, *columns: str) -> DataFrame:
    """`rows` dealt by a hash of `columns` to the session's number of shuffle partitions.

    The number is stated, as few small rows that stand for large objects would otherwise be
    coalesced into one task.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def dealt_evenly(keys: DataFrame) -> DataFrame:
    """Rows of few objects each, the same number of them for every task; `key` names the object.

    A hash of some dozens of keys gives one task twice as many as the next.
    """
    tasks = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.repartitionByRange(tasks, F.xxhash64("key"))


def write_objects(
    lines: DataFrame, root: str, envelope: Callable[[str], tuple[str, str]] | None = None
) -> DataFrame:
    """Write one object for each key, from its lines in order of `pos`, unless the key is taken.

    `lines` has key, pos and text. Returns a row (key, size, sha256, status) for each: created,
    existing (the same content is there), or conflict (other content is there and stays). A key's
    lines go through one task, piece by piece; the object appears under its name by a rename, so
    a task that is lost or repeated leaves no half object. With `envelope`, the first and the
    last line of an object are those it gives for the key, and commas part the lines between.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key: str, size: int, sha: str, status: str) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([key]), pa.array([size], pa.int64()), pa.array([sha]), pa.array([status])],
                names=["key", "size", "sha256", "status"],
            )

        current = None
        for batch in batches:
            # Lines of a key lie together, so a batch is a few runs of them.
            runs, start = pc.run_end_encode(batch.column("key")), 0
            for key, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if current is None or current.key != key:
                    if current is not None:
                        yield out(*current.close())
                    current = _Object(root, key, envelope)
                current.add(batch.column("text").slice(start, end - start).to_pylist())
                start = end
        if current is not None:
            yield out(*current.close())

    sorted_lines = dealt(lines, "key").sortWithinPartitions("key", "pos").select("key", "text")
    return sorted_lines.mapInArrow(run, "key string, size bigint, sha256 string, status string")


class _Object:
    """An object that is being written beside its name."""

    def __init__(self, root: str, key: str, envelope: Callable[[str], tuple[str, str]] | None) -> None:
        self.key = key
        self.uri = f"{root.rstrip('/')}/{key}"
        self.fs, self.path = resolve(self.uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        folder, _, name = self.path.rpartition("/")
        self.waiting = f"{folder}/.{name}.{uuid4().hex}"
        self.stream = self.fs.open_output_stream(self.waiting, compression=None)
        self.packer = zlib.compressobj(wbits=31) if key.endswith(".gz") else None
        self.hash, self.size, self.lines = hashlib.sha256(), 0, 0
        self.separator, self.last = "\n", None
        if envelope is not None:
            first, self.last = envelope(key)
            self._write(first + "\n")
            self.separator = "\n,"

    def add(self, texts: list[str | None]) -> None:
        """Append some lines."""
        text = self.separator.join([t or "" for t in texts]) + "\n"
        self._write("," + text if self.last is not None and self.lines else text)
        self.lines += len(texts)

    def _write(self, text: str) -> None:
        body = text.encode()
        self.hash.update(body)
        self.size += len(body)
        self.stream.write(body if self.packer is None else self.packer.compress(body))

    def close(self) -> tuple[str, int, str, str]:
        if self.last is not None:
            self._write(self.last + "\n")
        if self.packer is not None:
            self.stream.write(self.packer.flush())
        self.stream.close()
        sha = self.hash.hexdigest()
        if self.fs.get_file_info(self.path).type == pafs.FileType.NotFound:
            self.fs.move(self.waiting, self.path)
            return self.key, self.size, sha, "created"
        held = hashlib.sha256()
        for piece in chunks(self.uri):
            held.update(piece)
        self.fs.delete_file(self.waiting)
        return self.key, self.size, sha, "existing" if held.hexdigest() == sha else "conflict"


def measure_objects(keys: DataFrame, root: str, measure: Any, schema: str) -> DataFrame:
    """`measure(uri)` of each key below `root`, a dict of the schema's further columns.

    Only the objects of `keys` are opened, by the tasks that hold them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("key").to_pylist()
            found = [measure(f"{root.rstrip('/')}/{key}") for key in names]
            columns = {"key": names} | {c: [f[c] for f in found] for c in kinds}
            yield pa.RecordBatch.from_pydict(columns, schema=shape)

    from pyspark.sql.pandas.types import to_arrow_schema

    parsed = keys.sparkSession.createDataFrame([], f"key string, {schema}").schema
    shape, kinds = to_arrow_schema(parsed), [f.name for f in parsed.fields[1:]]
    # Opening is what takes time, so keys are dealt evenly however few files they come from.
    return dealt_evenly(keys.select("key").distinct()).mapInArrow(run, parsed)
