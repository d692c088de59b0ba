"""What the operators share: Arrow access to texts, stored intermediate tables, word hashes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pricetide.session import ensure_checkpoint_dir

#: Bytes of text that numpy code handles at a time; a longer text is handled alone and whole.
SLICE_BYTES = 1_000_000

#: Bytes of text whose words are hashed at a time.
HASH_BYTES = 1 << 15

#: Spark's setting to delete an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: The separators of words, and the lower-casing of A-Z.
SPACES = b"\x09\x0a\x0b\x0c\x0d\x20"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = b"abcdefghijklmnopqrstuvwxyz"

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[list(UPPER)] = list(LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder; it is deleted when the application ends."""
    path = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def store(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it again: the lineage ends there.

    The shuffle files of the write are deleted with it, so they don't add up over the steps of an
    operator; nothing reads them again.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*stored: DataFrame) -> None:
    """Delete what `store` has written, once every frame that reads it is stored itself."""
    for df in stored:
        spark = df.sparkSession
        own = {path.rsplit("/", 1)[0] for path in df.inputFiles()}
        for path in own:
            if path.rsplit("/", 1)[-1].startswith("llm-"):
                place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def held_out(divisor: int, doc_id: str = "doc_id") -> F.Column:
    """True for rows whose crc32(doc_id as text) mod `divisor` is 1; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor == 1, F.lit(False))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of `batch` with at most `limit` bytes in `column`, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(first, last - first)
        first = last


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and len + 1 offsets; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if column.offset or len(column) == 0:
        column = pa.concat_arrays([column, pa.array([], pa.large_binary())])
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[places[0] : places[-1]], places - places[0]


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of `flags` (one per byte or word) between consecutive offsets."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def word_places(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the runs of `inside`, and len(offsets) word offsets of the texts."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_constants(n: int, seed: int) -> np.ndarray:
    """`n` fixed odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_BYTES = odd_constants(256, 7)
_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        n = 1 << (n - 1).bit_length()
        for at, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[at] = np.multiply.accumulate(steps)
    return _powers


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word from its bytes: a polynomial over all bytes, sums taken apart.

    Words are in order and don't overlap. They are hashed some HASH_BYTES at a time, a longer one
    alone: a word's hash doesn't depend on where it lies, and what is needed stays in the cache.
    """
    value = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        base = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, base + HASH_BYTES, side="right")))
        own = data[base : int(ends[last - 1])]
        up, down = _power_tables(len(own) + 1)
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(_BYTES[own] * up[: len(own)], out=sums[1:])
        begin = starts[first:last] - base
        value[first:last] = (sums[ends[first:last] - base] - sums[begin]) * down[begin]
        first = last
    return mix(value ^ mix((ends - starts).astype(np.uint64)))


def window_hashes(words: np.ndarray, width: int, seed: int = 11) -> np.ndarray:
    """A hash of each `width` consecutive word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for at, factor in enumerate(odd_constants(width, seed)):
        total += words[at : at + n] * factor
    return mix(total)


#: Keys that hold more than this share of the rows are joined by a broadcast; they are fewer than that.
HOT_KEYS = 10_000


def attach(rows: DataFrame, found: DataFrame, *key: str) -> DataFrame:
    """`rows` left-joined to `found`: one row a key, and in `copies` how many rows hold that key.

    Keys of many rows go by a broadcast of fewer than HOT_KEYS rows, so they are not gathered in a
    task. Both frames are read several times and should be stored; a null key finds nothing.
    """
    total = rows.count()
    often = F.broadcast(found.where(F.col("copies") * HOT_KEYS > total).drop("copies"))
    seldom = found.where(F.col("copies") * HOT_KEYS <= total).drop("copies")
    names = list(key)
    rest = rows.join(often.select(*names), names, "left_anti").join(seldom, names, "left")
    return rows.join(often, names).unionByName(rest)


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python 1,000 rows at a time, unless the session asks for its own number.

    Spark's default of 10,000 rows is meant for short ones; it costs each Python worker
    several copies of the texts of a whole batch.
    """
    key, default = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, "1000")


def with_result(
    docs: DataFrame,
    name: str,
    kind: T.StructType,
    make: Callable[[], Callable[[pa.RecordBatch], pa.Array]],
) -> DataFrame:
    """`docs` and a struct column `name`, computed batch by batch.

    `make()` runs once in each task and returns the function that gets each Arrow batch.
    A column of `docs` that is called `name` already is replaced.
    """
    small_batches(docs.sparkSession)
    kept = docs.drop(name)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, compute(batch)], names=[*batch.schema.names, name]
            )

    return kept.mapInArrow(run, schema)


def struct(fields: dict[str, Any]) -> pa.StructArray:
    """A struct array of equally long arrays."""
    arrays = [x if isinstance(x, pa.Array) else pa.array(x) for x in fields.values()]
    return pa.StructArray.from_arrays(arrays, list(fields))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_platt(raw: np.ndarray, label: np.ndarray, weight: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic fit of `label` on `raw`, by Newton steps.

    A slight pull towards a flat curve keeps the fit finite where classes separate, and on
    empty or one-sided input.
    """
    x = np.stack([raw, np.ones_like(raw)], 1)
    at = np.zeros(2)
    for _ in range(steps):
        p = sigmoid(x @ at)
        slope = x.T @ (weight * (p - label)) + 1e-3 * at
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        at -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(at[0]), float(at[1])


def with_row_key(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", key: str = "__key") -> DataFrame:
    """`docs` with a column `key`: the id, made different for rows of one id with different texts.

    Keys are in the order of the ids, strings for string ids and whole numbers for others, wide
    enough for any id. Rows that repeat both id and text have the same key, rows without an id
    a null one.
    """
    digest = F.xxhash64(text)  # a null text has a number too
    repeated = docs.where(F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.min(digest).alias("a"), F.max(digest).alias("b"))
    repeated = store(repeated.where("a <> b").select(doc_id))
    if repeated.isEmpty():
        return docs.withColumn(key, F.col(doc_id))
    texts = docs.select(doc_id, digest.alias("__digest")).join(repeated, doc_id, "left_semi").distinct()
    place = F.row_number().over(Window.partitionBy(doc_id).orderBy("__digest"))
    numbered = store(texts.withColumn("__place", place))
    most = numbered.agg(F.max("__place")).first()[0] + 1
    place = F.coalesce("__place", F.lit(0))
    if isinstance(docs.schema[doc_id].dataType, T.StringType):
        made = F.concat(doc_id, F.lit("\0"), F.lpad(place.cast("string"), 10, "0"))
    else:
        # A product of 64-bit ids doesn't fit 64 bits.
        made = F.col(doc_id).cast("decimal(20,0)") * F.lit(most).cast("decimal(17,0)") + place.cast("decimal(17,0)")
        made = made.cast("decimal(38,0)")
    keyed = docs.withColumn("__digest", digest).join(numbered, [doc_id, "__digest"], "left")
    return keyed.select(*docs.columns, made.alias(key))
