"""Versioned tables: new files beside the old ones, then one atomic switch.

Layout of a table's folder:

    data/<partition columns>/batch=<id>/part-*.parquet    files of one batch, never changed
    versions/<number>.json                                the schema, then a line a partition: folder, rows, hash

A writer puts a batch's files where no version refers to them yet, measures what it wrote, and
commits by renaming a complete version file to the next number. The rename fails if another
writer was first, and a run that dies before it leaves the last version as it was. Readers
take the newest version file and read the folders it names. A version lists one line for each
partition value with the count and the additive hash of its rows; the table's fingerprint is
made from the sums of those, so no stored row is read again to know it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any
from urllib.parse import unquote
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide.functions.hashing import row_sum

#: Versions that stay readable after a commit.
KEPT_VERSIONS = 3


def _nullable(kind: T.DataType) -> T.DataType:
    """The type with nulls allowed at every depth, as files are read back."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_nullable(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(_nullable(kind.keyType), _nullable(kind.valueType))
    return kind


class VersionConflict(RuntimeError):
    """Another writer committed the version that this one was about to."""


@dataclass(frozen=True)
class Part:
    """What one partition of a table holds: its folder below `data`, rows and additive hash."""

    folder: str
    rows: int
    hash: int

    @property
    def place(self) -> str:
        """The folder without its batch: the partition's values."""
        return self.folder.rpartition("batch=")[0]


@dataclass(frozen=True)
class Receipt:
    output: str
    rows: int
    fingerprint: str
    changed: bool


def content_hash(names: Iterable[str]) -> F.Column:
    """Aggregate: the additive hash of rows over `names`, zero without rows."""
    row = F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"})
    return F.coalesce(row_sum(row), F.lit(0).cast("decimal(38,0)"))


def fingerprint_of(parts: Iterable[Part]) -> str:
    """The fingerprint of a table from its partitions' counts and hashes, which add up."""
    parts = list(parts)
    total = f"{sum(p.rows for p in parts)}|{sum(p.hash for p in parts)}"
    return hashlib.sha256(total.encode()).hexdigest()


class _Files:
    """The few file operations a commit needs, through the session's own file system."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self.gateway = spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = self.path(root)
        self.fs = self.root.getFileSystem(self.conf)
        self.context = self.hadoop.fs.FileContext.getFileContext(self.root.toUri(), self.conf)

    def path(self, text: str) -> Any:
        return self.hadoop.fs.Path(text)

    def names(self, folder: str) -> list[str]:
        place = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(place)] if self.fs.exists(place) else []

    def read(self, file: str) -> str:
        stream = self.fs.open(self.path(file))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, file: str, text: str) -> None:
        stream = self.fs.create(self.path(file), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename_new(self, old: str, new: str) -> bool:
        """Atomic rename; false if `new` exists already."""
        options = self.gateway.new_array(self.hadoop.fs.Options.Rename, 0)
        try:
            self.context.rename(self.path(old), self.path(new), options)
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            return False
        return True

    def delete(self, place: str) -> None:
        self.fs.delete(self.path(place), True)


class VersionedTable:
    """A table below `root` whose content changes by atomic switches between versions."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        schema: T.StructType,
        partition_by: list[str] | None = None,
        sort_by: list[str] | None = None,
    ) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.schema = _nullable(schema)
        self.partition_by = partition_by or []
        self.sort_by = sort_by or []
        self.files = _Files(spark, self.root)

    # --- reading -----------------------------------------------------------------

    def versions(self) -> list[int]:
        """Numbers of the committed versions, oldest first."""
        names = (n.removesuffix(".json") for n in self.files.names(f"{self.root}/versions") if n.endswith(".json"))
        return sorted(int(n) for n in names if n.isdigit())

    def parts(self, version: int | None = None) -> list[Part] | None:
        """The partitions of a version, by default of the newest; None without any."""
        known = self.versions()
        if not known:
            return None
        text = self.files.read(self._version_file(known[-1] if version is None else version))
        return [Part(p["folder"], p["rows"], int(p["hash"])) for p in map(json.loads, text.splitlines()[1:])]

    def read(
        self, version: int | None = None, keep: Callable[[dict[str, str]], bool] | None = None
    ) -> DataFrame | None:
        """The rows of a version, by default of the newest; None if the table doesn't exist.

        `keep` is asked for each partition's values (as text); other folders aren't listed.
        """
        parts = self.parts(version)
        if parts is None:
            return None
        return self._read_folders(p.folder for p in parts if p.rows and (keep is None or keep(self.values(p))))

    def read_partitions(self, wanted: list[dict[str, Any]]) -> DataFrame | None:
        """The newest rows of the partitions whose values are in `wanted`."""
        among = {tuple(str(w[c]) for c in self.partition_by) for w in wanted}
        return self.read(keep=lambda values: tuple(values.values()) in among)

    def fingerprint(self) -> tuple[int, str] | None:
        """Rows and fingerprint of the newest version; no data is read."""
        parts = self.parts()
        return None if parts is None else (sum(p.rows for p in parts), fingerprint_of(parts))

    def manifest(self) -> DataFrame:
        """A row (output, folder, rows, hash) for each partition of the newest version."""
        rows = [(self.root, p.place.rstrip("/"), p.rows, str(p.hash)) for p in self.parts() or []]
        return self.spark.createDataFrame(rows, "output string, folder string, rows bigint, hash string")

    # --- writing -----------------------------------------------------------------

    def replace(self, rows: DataFrame) -> Receipt:
        """Make `rows` the whole content; a new version only if the content differs."""
        return self._switch(rows, lambda old, new: new)

    def replace_partitions(
        self, rows: DataFrame, emptied: list[dict[str, Any]] | None = None, dealt: bool = False
    ) -> Receipt:
        """Replace the partitions that `rows` has values of; others stay, unread.

        Partitions of `emptied` go even if `rows` has none of them. `dealt` says that `rows` are
        dealt by range and sorted in the table's order already.
        """
        gone = {tuple(str(e[c]) for c in self.partition_by) for e in emptied or []}

        def merged(old: list[Part], new: list[Part]) -> list[Part]:
            touched = {p.place for p in new}
            stay = [p for p in old if p.place not in touched and tuple(self.values(p).values()) not in gone]
            return stay + new

        return self._switch(rows, merged, dealt)

    @property
    def order(self) -> list[str]:
        """The columns that stored rows are dealt and sorted by."""
        return [*self.partition_by, *[c for c in self.sort_by if c not in self.partition_by]]

    def _switch(self, rows: DataFrame, merge: Any, dealt: bool = False) -> Receipt:
        known = self.versions()
        old = self.parts(known[-1]) if known else None
        batch = uuid4().hex
        new = self._write_batch(rows, batch, dealt)
        was = {p.place: p for p in old or []}
        # A partition with the rows it had keeps its old files.
        same = [p for p in new if p.place in was and (was[p.place].rows, was[p.place].hash) == (p.rows, p.hash)]
        new = [was[p.place] if p in same else p for p in new]
        result = sorted(merge(old or [], new), key=lambda p: p.folder)
        unused = [p.folder for p in same]
        receipt_rows, print_ = sum(p.rows for p in result), fingerprint_of(result)
        if old is not None and result == sorted(old, key=lambda p: p.folder):
            self._drop(unused)
            return Receipt(self.root, receipt_rows, print_, False)
        self._commit((known[-1] if known else 0) + 1, result, batch)
        self._drop(unused)
        self.expire()
        return Receipt(self.root, receipt_rows, print_, True)

    def _fixed(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])

    def _write_batch(self, rows: DataFrame, batch: str, dealt: bool = False) -> list[Part]:
        """Write the files of a batch and measure them, one row a partition."""
        fixed = self._fixed(rows)
        if self.order and not dealt:
            fixed = fixed.repartitionByRange(*self.order).sortWithinPartitions(*self.order)
        writer = fixed.withColumn("batch", F.lit(batch)).write.mode("append").option("compression", "zstd")
        writer.partitionBy(*self.partition_by, "batch").parquet(f"{self.root}/data")
        names = self._folders_of(batch)
        if not names:
            return [] if self.partition_by else [Part(f"batch={batch}", 0, 0)]
        measured = (
            self._read_folders(names, with_folder=True)
            .groupBy("_folder")
            .agg(F.count(F.lit(1)).alias("rows"), content_hash(self.schema.names).alias("hash"))
        )
        return [Part(r["_folder"], r["rows"], int(r["hash"])) for r in measured.collect()]

    def _folders_of(self, batch: str) -> list[str]:
        """Folders below `data` that hold a batch's files."""
        pattern = "/".join(["*"] * len(self.partition_by) + [f"batch={batch}"])
        base = self.files.path(f"{self.root}/data")
        if not self.files.fs.exists(base):
            return []
        found = self.files.fs.globStatus(self.files.path(f"{self.root}/data/{pattern}")) or []
        depth = len(self.partition_by) + 1
        return ["/".join(str(s.getPath().toString()).split("/")[-depth:]) for s in found]

    def _read_folders(self, folders: Iterable[str], with_folder: bool = False) -> DataFrame:
        named = [f"{self.root}/data/{f}" for f in folders]
        shape = T.StructType([*self.schema.fields, T.StructField("batch", T.StringType())])
        if not named:
            return self.spark.createDataFrame([], self.schema)
        data = self.spark.read.schema(shape).option("basePath", f"{self.root}/data").parquet(*named)
        if not with_folder:
            return data.select(*self.schema.names)
        depth = len(self.partition_by) + 1
        segments = F.split(F.col("_metadata.file_path"), "/")
        folder = F.array_join(F.slice(segments, F.size(segments) - depth, depth), "/")
        # The file's path is a URI; folder names may hold escapes of their own, so it is decoded once.
        return data.select("*", F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B"))).alias("_folder"))

    def values(self, part: Part) -> dict[str, str]:
        """The partition's values by column, as text."""
        pieces = (x.partition("=") for x in part.place.split("/") if x)
        return {name: unquote(value) for name, _, value in pieces}

    def _version_file(self, number: int) -> str:
        return f"{self.root}/versions/{number:012d}.json"

    def _commit(self, number: int, parts: list[Part], batch: str) -> None:
        shape = {"schema": self.schema.jsonValue(), "partition_by": self.partition_by, "sort_by": self.sort_by}
        lines = [json.dumps(shape)]
        lines += [json.dumps({"folder": p.folder, "rows": p.rows, "hash": str(p.hash)}) for p in parts]
        self.files.fs.mkdirs(self.files.path(f"{self.root}/versions"))
        waiting = f"{self.root}/versions/.{batch}"
        self.files.write(waiting, "\n".join(lines))
        if not self.files.rename_new(waiting, self._version_file(number)):
            self.files.delete(waiting)
            raise VersionConflict(f"version {number} of {self.root} was written meanwhile")

    def _drop(self, folders: Iterable[str]) -> None:
        for folder in folders:
            self.files.delete(f"{self.root}/data/{folder}")

    def expire(self, keep: int = KEPT_VERSIONS) -> None:
        """Forget all but the newest `keep` versions, and delete the files only they name."""
        known = self.versions()
        kept = {p.folder for v in known[-keep:] for p in self.parts(v) or []}
        for version in known[:-keep]:
            folders = {p.folder for p in self.parts(version) or []} - kept
            self.files.delete(self._version_file(version))
            self._drop(folders)

    def clean(self) -> int:
        """Delete files of batches that no version names, as a run that died leaves them.

        Only for a time when nobody writes to the table. Returns the number of folders deleted.
        """
        kept = {p.folder for v in self.versions() for p in self.parts(v) or []}
        lost = [f for f in self._folders_of("*") if f not in kept]
        self._drop(lost)
        for name in self.files.names(f"{self.root}/versions"):
            if name.startswith(".") and not name.endswith(".crc"):
                self.files.delete(f"{self.root}/versions/{name}")
        return len(lost)


def open_table(spark: SparkSession, root: str, schema: T.StructType | None = None) -> VersionedTable | None:
    """The versioned table below `root`, with its own schema or the one given; None without any."""
    table = VersionedTable(spark, root, schema or T.StructType([]))
    known = table.versions()
    if not known:
        return None
    shape = json.loads(table.files.read(table._version_file(known[-1])).splitlines()[0])
    return VersionedTable(
        spark, root, schema or T.StructType.fromJson(shape["schema"]), shape["partition_by"], shape["sort_by"]
    )


def upsert_keys(table: VersionedTable, rows: DataFrame, keys: list[str], buckets: int) -> Receipt:
    """Insert or replace rows by key; only the buckets that the keys fall into are rewritten.

    `table` has a column `bucket`, its partition. The same number of buckets is to be given
    each time. Of rows that repeat a key one wins, the greatest in order of all columns.
    """
    if table.partition_by != ["bucket"]:
        raise ValueError("the table must be partitioned by bucket")
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")
    rest = sorted(c for c in rows.columns if c not in (*keys, "bucket"))
    best = rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_row"))
    incoming = best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest], bucket).select(*table.schema.names)
    # At most `buckets` numbers.
    touched = [{"bucket": r["bucket"]} for r in incoming.select("bucket").distinct().collect()]
    held = table.read_partitions(touched)
    if held is not None:
        held = held.join(incoming.select(*keys), keys, "left_anti")
        incoming = held.select(*table.schema.names).unionByName(incoming)
    return table.replace_partitions(incoming)
