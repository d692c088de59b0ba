"""Snapshot files as a data source: a partition of files each, their JSON read as a stream.

A file's envelope is tokenised piece by piece. Its records become rows of their own text with
their place in the list, so neither a document nor its list is ever one value.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import marshal
import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import IO, Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pricetide.functions.ids import NAMESPACE
from pricetide.sources.object_files import chunks, dealt_evenly, measure_objects, under
from pricetide.sources.snapshots import ENVELOPE_MEMBERS

#: Bytes of files (as stored) that one partition reads, and rows that go out together.
PARTITION_BYTES = 64 << 20
BATCH_ROWS = 8_192
#: Characters of records that are kept in memory while it isn't known yet which list counts.
HELD_CHARS = 16 << 20
#: A value of more characters than this counts as broken JSON.
VALUE_CHARS = 256 << 20

RECORDS = "path string, source_pos int, item string"
MEASURES = (
    "size bigint, sha256 string, valid boolean, created_at string, bare bigint, data bigint,"
    " products bigint, priceGuide bigint, priceGuides bigint"
)
_DECODE = json.JSONDecoder().raw_decode
_SPACE = " \t\r\n"


class BrokenJson(ValueError):
    """The text is not one JSON value."""


class JsonStream:
    """Tokens of a JSON text that arrives in pieces."""

    def __init__(self, pieces: Iterable[str]) -> None:
        self.pieces = iter(pieces)
        self.text, self.at = "", 0

    def more(self) -> bool:
        """Append the next piece and forget what was read."""
        for piece in self.pieces:
            if piece:
                self.text, self.at = self.text[self.at :] + piece, 0
                return True
        return False

    def peek(self) -> str:
        """The next character that isn't white space; empty at the end."""
        while True:
            while self.at < len(self.text):
                if self.text[self.at] not in _SPACE:
                    return self.text[self.at]
                self.at += 1
            if not self.more():
                return ""

    def take(self, wanted: str) -> None:
        if self.peek() != wanted:
            raise BrokenJson(f"expected {wanted}")
        self.at += 1

    def value(self) -> tuple[Any, str]:
        """The next value and its text."""
        self.peek()
        while True:
            try:
                found, end = _DECODE(self.text, self.at)
            except (json.JSONDecodeError, RecursionError) as error:
                if len(self.text) - self.at > VALUE_CHARS or not self.more():
                    raise BrokenJson(str(error)) from error
                continue
            # A number at the end of a piece may go on.
            if end == len(self.text) and self.more():
                continue
            text, self.at = self.text[self.at : end], end
            return found, text

    def elements(self) -> Iterator[str]:
        """The texts of a list's elements, the list being next."""
        self.take("[")
        if self.peek() == "]":
            self.at += 1
            return
        while True:
            yield self.value()[1]
            if self.peek() == "]":
                self.at += 1
                return
            self.take(",")

    def members(self) -> Iterator[str]:
        """The names of an object's members; whoever asks has to read each value."""
        self.take("{")
        if self.peek() == "}":
            self.at += 1
            return
        while True:
            if self.peek() != '"':
                raise BrokenJson("expected a name")
            name = self.value()[0]
            self.take(":")
            yield name
            if self.peek() == "}":
                self.at += 1
                return
            self.take(",")

    def skip(self) -> None:
        """Read past a value without keeping all of it."""
        first = self.peek()
        if first == "[":
            for _ in self.elements():
                pass
        elif first == "{":
            for _ in self.members():
                self.skip()
        else:
            self.value()


class Held:
    """Texts that are kept: `keep` characters of them in memory, earlier ones in a file without a name."""

    def __init__(self, keep: int) -> None:
        self.keep, self.chars = keep, 0
        self.texts: list[str] = []
        self.file: IO[bytes] | None = None

    def add(self, text: str) -> None:
        self.texts.append(text)
        self.chars += len(text)
        if self.chars > self.keep:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            marshal.dump(self.texts, self.file)
            self.texts, self.chars = [], 0

    def __iter__(self) -> Iterator[str]:
        if self.file is not None:
            end = self.file.tell()
            self.file.seek(0)
            while self.file.tell() < end:
                yield from marshal.load(self.file)
        yield from self.texts


@dataclass
class Document:
    """What one pass over a document finds."""

    size: int = 0
    sha256: str | None = None
    valid: bool = False
    created_at: str | None = None
    #: Sizes and places (which member) of the lists that may hold the records.
    lists: dict[str, tuple[int, int]] = field(default_factory=dict)
    #: The lists' records, if they were asked for.
    held: dict[str, Held] = field(default_factory=dict)

    @property
    def chosen(self) -> str | None:
        """The list that counts: a bare one, or the first member in order of preference."""
        return next((n for n in ("", *ENVELOPE_MEMBERS) if n in self.lists), None)


def _texts(uri: str, document: Document | None = None) -> Iterator[str]:
    """The decoded text of a file; with a document, its size and hash on the way."""
    decoder = codecs.getincrementaldecoder("utf-8-sig")()
    digest = hashlib.sha256()
    for piece in chunks(uri):
        if document is not None:
            digest.update(piece)
            document.size += len(piece)
            document.sha256 = digest.hexdigest()
        try:
            text = decoder.decode(piece)
        except UnicodeDecodeError as error:
            raise BrokenJson(str(error)) from error
        yield text
    if document is not None:
        document.sha256 = digest.hexdigest()
    try:
        decoder.decode(b"", True)
    except UnicodeDecodeError as error:
        raise BrokenJson(str(error)) from error


def _scan(stream: JsonStream, document: Document, keep: int | None) -> None:
    def count(name: str, place: int) -> None:
        n = 0
        if keep is None:
            for _ in stream.elements():
                n += 1
        else:
            held = document.held[name] = Held(keep)
            for text in stream.elements():
                n += 1
                held.add(text)
        document.lists[name] = (n, place)

    if stream.peek() == "[":
        count("", 0)
    elif stream.peek() == "{":
        for place, name in enumerate(stream.members()):
            document.lists.pop(name, None)
            if name in ENVELOPE_MEMBERS and stream.peek() == "[":
                count(name, place)
            elif name == "createdAt" and stream.peek() == '"':
                document.created_at = stream.value()[0]
            else:
                stream.skip()
    else:
        stream.value()
    if stream.peek():
        raise BrokenJson("text after the end")


def read_document(uri: str, keep: int | None = None) -> Document:
    """One pass over a file: hash, size, whether it is JSON, and its lists. Unreadable: no hash.

    With `keep`, the lists' records are held, that many characters of a list in memory.
    """
    document = Document()
    try:
        texts = _texts(uri, document)
        try:
            _scan(JsonStream(texts), document, keep)
            document.valid = True
        except BrokenJson:
            document.lists, document.held = {}, {}
            for piece in _rest(uri, document):
                pass
    except (OSError, EOFError):
        return Document()
    return document


def _rest(uri: str, document: Document) -> Iterator[bytes]:
    """Hash and size of the whole of a file that isn't JSON."""
    document.size, digest = 0, hashlib.sha256()
    for piece in chunks(uri):
        digest.update(piece)
        document.size += len(piece)
        yield piece
    document.sha256 = digest.hexdigest()


def records(uri: str, keep: int = HELD_CHARS) -> Iterator[str]:
    """The texts of a document's records; none for an unknown envelope or broken JSON.

    The file is read once. No record goes out before its end, as only then it is known that it
    is JSON and which list counts.
    """
    document = read_document(uri, keep)
    if document.chosen is not None:
        yield from document.held.pop(document.chosen)


def measure(uri: str) -> dict[str, Any]:
    """The columns of MEASURES for one file."""
    found = read_document(uri)
    sizes = {name: n for name, (n, _) in found.lists.items()}
    return {
        "size": found.size if found.sha256 else None,
        "sha256": found.sha256,
        "valid": found.valid if found.sha256 else None,
        "created_at": found.created_at,
        "bare": sizes.get(""),
        **{name: sizes.get(name) for name in ENVELOPE_MEMBERS},
    }


class _Files(InputPartition):
    def __init__(self, uris: list[str]) -> None:
        self.uris = uris


class SnapshotFiles(DataSource):
    """Records (`mode` records) or measures (`mode` measures) of the JSON files below `path`."""

    @classmethod
    def name(cls) -> str:
        return "snapshot_files"

    def schema(self) -> str:
        return RECORDS if self.options.get("mode", "records") == "records" else f"path string, {MEASURES}"

    def reader(self, schema: Any) -> DataSourceReader:
        return _SnapshotReader(self.options["path"].split("\n"), self.options.get("mode", "records"))


class _SnapshotReader(DataSourceReader):
    def __init__(self, roots: list[str], mode: str) -> None:
        self.roots, self.mode = roots, mode

    def partitions(self) -> list[InputPartition]:
        found = [(u, i) for root in self.roots for u, i in under(root) if i.type == pafs.FileType.File]
        files = [(u, i.size or 0) for u, i in found if ".json" in u.rpartition("/")[2]]
        out: list[InputPartition] = []
        # Small files share a partition, but there are enough partitions for many tasks.
        most = max(1, min(PARTITION_BYTES, sum(s for _, s in files) // 32))
        group, held = [], 0
        for uri, size in files:
            if group and held + size > most:
                out.append(_Files(group))
                group, held = [], 0
            group.append(uri)
            held += size
        return [*out, _Files(group)]

    def read(self, partition: Any) -> Iterator[pa.RecordBatch]:
        if self.mode == "records":
            yield from self._records(partition.uris)
            return
        for uri in partition.uris:
            found = measure(uri)
            kinds = {"size": pa.int64(), "sha256": pa.string(), "valid": pa.bool_(), "created_at": pa.string()}
            columns = [pa.array([v], kinds.get(k, pa.int64())) for k, v in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array([uri]), *columns], names=["path", *found])

    def _records(self, uris: list[str]) -> Iterator[pa.RecordBatch]:
        paths: list[str] = []
        places: list[int] = []
        items: list[str] = []

        def out() -> pa.RecordBatch:
            columns = [pa.array(paths, pa.string()), pa.array(places, pa.int32()), pa.array(items, pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["path", "source_pos", "item"])

        for uri in uris:
            for place, text in enumerate(records(uri)):
                if text[0] != "{":
                    continue
                paths.append(uri)
                places.append(place)
                items.append(text)
                if len(items) == BATCH_ROWS:
                    yield out()
                    paths, places, items = [], [], []
        if items:
            yield out()


def _load(spark: SparkSession, paths: str | list[str], mode: str) -> DataFrame:
    spark.dataSource.register(SnapshotFiles)
    roots = [paths] if isinstance(paths, str) else paths
    return with_key(spark.read.format("snapshot_files").option("path", "\n".join(roots)).option("mode", mode).load())


def with_key(df: DataFrame) -> DataFrame:
    """Add key, kind, game_key and run_date as the path of a snapshot names them."""
    pattern = NAMESPACE + r"/([a-z]+)/([a-z0-9]+)/\d{4}/\d{2}/(\d{4}-\d{2}-\d{2})[^/]*$"
    part = F.split(F.col("key"), "/")
    return (
        df.withColumn("key", F.regexp_extract("path", pattern, 0))
        .withColumn("kind", F.get(part, F.lit(1)))
        .withColumn("game_key", F.get(part, F.lit(2)))
        .withColumn("run_date", F.substring(F.get(part, F.lit(5)), 1, 10).try_cast("date"))
    )


def read_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A row for each record of the snapshot files below `paths`: key columns, source_pos, item."""
    return _load(spark, paths, "records").drop("path")


def read_measures(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A row for each snapshot file below `paths`: key columns and MEASURES; no body."""
    return _load(spark, paths, "measures").drop("path")


def key_records(keys: DataFrame, root: str) -> DataFrame:
    """The records of the files that `keys` names below `root`: its columns, source_pos, item.

    Each file is opened by the task that holds its key; one row a file comes in, records go out.
    """
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    fields = [StructField("source_pos", IntegerType()), StructField("item", StringType())]
    schema = StructType([*keys.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, key in enumerate(batch.column("key").to_pylist()):
                places: list[int] = []
                items: list[str] = []

                def out(row: int = row, batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                    same = batch.take(pa.array([row] * len(items), pa.int64()))
                    added = [pa.array(places, pa.int32()), pa.array(items, pa.string())]
                    return pa.RecordBatch.from_arrays([*same.columns, *added], names=schema.names)

                for place, text in enumerate(records(f"{root.rstrip('/')}/{key}")):
                    if text[0] == "{":
                        places.append(place)
                        items.append(text)
                    if len(items) == BATCH_ROWS:
                        yield out()
                        places.clear()
                        items.clear()
                if items:
                    yield out()

    return dealt_evenly(keys).mapInArrow(run, schema)


def measure_keys(keys: DataFrame, root: str) -> DataFrame:
    """MEASURES of the files that `keys` names below `root`; no other file is opened."""
    return measure_objects(keys, root, measure, MEASURES)
