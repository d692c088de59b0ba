"""Filter interaction audit: what each filter removes in every order the filters can be applied in.

1. Every row's failing filters become a bit mask, and its marks (labels) another one.
2. Rows are dealt into ranges of (part, id). Within a range each filter has a sorted posting list
   of the ids that fail it, and each mark one of the ids that bear it.
3. Unions of the lists of every set of filters, and what a filter's list has beyond such a union,
   come from merges that gallop through the longer list. Their sizes add up over the ranges.
4. All orders' steps are read off those sums.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pricetide.llm.common import attach, small_batches, store

#: Bytes of text whose words are split at a time.
SPLIT_BYTES = 1 << 20
SYMBOL = re.compile(rb"[#$%&*|]")
UPPER = np.zeros(256, bool)
UPPER[65:91] = True


def absent(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Members of the sorted list `a` that the sorted list `b` lacks; the shorter one gallops."""
    if len(a) == 0 or len(b) == 0:
        return a
    if len(a) <= len(b):
        at = np.searchsorted(b, a)
        return a[b[np.minimum(at, len(b) - 1)] != a]
    at = np.searchsorted(a, b)
    inside = at < len(a)
    at, b = at[inside], b[inside]
    keep = np.ones(len(a), bool)
    keep[at[a[at] == b]] = False
    return a[keep]


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sorted union of two sorted lists."""
    if len(a) < len(b):
        a, b = b, a
    new = absent(b, a)
    return np.insert(a, np.searchsorted(a, new), new) if len(new) else a


def block_sums(fails: np.ndarray, marks: np.ndarray, n_filters: int, n_marks: int) -> np.ndarray:
    """Sums of one id range: a row for each (filter, set of other filters applied before it).

    Columns: rows, failing, failing alone, failing or removed by now, removed here, and of these
    the ones with each mark.
    """
    lists = [np.flatnonzero(fails >> f & 1) for f in range(n_filters)]
    marked = [np.flatnonzero(marks >> m & 1) for m in range(n_marks)]
    unions = [np.zeros(0, np.int64)]
    for chosen in range(1, 1 << n_filters):
        top = chosen.bit_length() - 1
        unions.append(union(unions[chosen ^ 1 << top], lists[top]))
    out = []
    everyone = (1 << n_filters) - 1
    for f, before in cases(n_filters):
        here = absent(lists[f], unions[before])
        alone = absent(lists[f], unions[everyone ^ 1 << f])
        out.append(
            [len(fails), len(lists[f]), len(alone), len(unions[before | 1 << f]), len(here)]
            + [len(here) - len(absent(here, x)) for x in marked]
        )
    return np.array(out, np.int64)


def cases(n_filters: int) -> list[tuple[int, int]]:
    """All (filter, set of other filters as bits)."""
    return [(f, s) for f in range(n_filters) for s in range(1 << n_filters) if not s >> f & 1]


def interactions(rows: DataFrame, filters: Sequence[str], marks: Sequence[str]) -> DataFrame:
    """Every step of every order of `filters` for each part.

    `rows` has `part` (string), `id` (any type that sorts), `row` (long, different in each row),
    and a boolean column for each filter and each mark; null counts as false. Rows that repeat an
    id, or have none, count one by one. Returns part, filter_order (the filters' names joined),
    step (from 1), kept, removed, redundant, unique_fails, `<mark>_lost` for each mark, and
    shapley: the filter's removals summed over all orders. A part without rows has no result, so
    an empty table has none. At most six filters (720 orders).
    """
    if not 1 <= len(filters) <= 6:
        raise ValueError("one to six filters")
    n, m = len(filters), len(marks)

    def mask(names: Sequence[str]) -> F.Column:
        bits = [F.when(F.col(x), F.lit(1 << i)).otherwise(0) for i, x in enumerate(names)]
        return sum(bits, F.lit(0)).cast("int")

    packed = store(rows.select("part", "id", "row", mask(filters).alias("fails"), mask(marks).alias("marks")))
    dealt = packed.repartitionByRange("part", "id", "row").sortWithinPartitions("part", "id", "row")
    counts = ["rows", "failing", "alone", "gone", "removed", *(f"{x}_lost" for x in marks)]
    schema = T.StructType(
        [T.StructField("part", T.StringType()), T.StructField("filter", T.IntegerType()), T.StructField("before", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in counts]
    )
    which = np.array(cases(n), np.int32)

    def sums_of(part: str, sums: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array([part] * len(which), pa.string()), pa.array(which[:, 0]), pa.array(which[:, 1])]
        return pa.RecordBatch.from_arrays(columns + [pa.array(x) for x in sums.T.copy()], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sums = None, None
        for batch in batches:
            coded = batch.column("part").dictionary_encode()
            codes, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
            fails, marked = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("fails", "marks"))
            edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            for first, last in zip(edges, edges[1:], strict=False):
                if first == last:
                    continue
                part = names[codes[first]]
                block = block_sums(fails[first:last], marked[first:last], n, m)
                if part != current:
                    if current is not None:
                        yield sums_of(current, sums)
                    current, sums = part, block
                else:
                    sums = sums + block
        if current is not None:
            yield sums_of(current, sums)

    parts = dealt.select("part", "fails", "marks").mapInArrow(run, schema)
    total = parts.groupBy("part", "filter", "before").agg(*(F.sum(c).alias(c) for c in counts))
    steps = [
        ("".join(filters[f] for f in order), at + 1, order[at], sum(1 << f for f in order[:at]))
        for order in permutations(range(n))
        for at in range(n)
    ]
    # One row a step of an order: n! * n, at most 4,320.
    orders = rows.sparkSession.createDataFrame(steps, "filter_order string, step int, filter int, before int")
    placed = total.join(F.broadcast(orders), ["filter", "before"])
    return placed.select(
        "part",
        "filter_order",
        "step",
        (F.col("rows") - F.col("gone")).alias("kept"),
        "removed",
        (F.col("failing") - F.col("removed")).alias("redundant"),
        F.col("alone").alias("unique_fails"),
        *(f"{x}_lost" for x in marks),
        F.sum("removed").over(Window.partitionBy("part", "filter")).alias("shapley"),
    )


def _words(text: bytes) -> tuple[int, int]:
    """Words and distinct words; a long text is split piece by piece."""
    if len(text) <= SPLIT_BYTES:
        found = text.split()
        return len(found), len(set(found))
    n, seen, rest = 0, set(), b""
    for at in range(0, len(text), SPLIT_BYTES):
        piece = rest + text[at : at + SPLIT_BYTES]
        whole = piece.split()
        rest = whole.pop() if whole and not piece[-1:].isspace() else b""
        n += len(whole)
        seen.update(whole)
    if rest:
        n += 1
        seen.add(rest)
    return n, len(seen)


def read_flags(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "lang") -> DataFrame:
    """A row (id, part, row, A, B, C, D, digest) for each row of `docs`.

    A: under 200 words; B: 100 * distinct words < 50 * words; C: 100 * [A-Z] > 3 * code points;
    D: holds one of #$%&*|; digest: 128 bits of the text. A null text is empty, a null part ''.
    """
    small_batches(docs.sparkSession)
    taken = docs.select(
        F.col(doc_id).alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"),
    )
    flags = [T.StructField(x, T.BooleanType()) for x in "ABCD"]
    schema = T.StructType([*taken.schema.fields[:3], *flags, T.StructField("digest", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list] = [[], [], [], [], []]
            for value in batch.column("text"):
                body = value.as_py()
                n, distinct = _words(body)
                raw = np.frombuffer(body, np.uint8)
                points = len(raw) - int(np.count_nonzero((raw & 0xC0) == 0x80))
                upper = int(np.count_nonzero(UPPER[raw]))
                row = (n < 200, 100 * distinct < 50 * n, 100 * upper > 3 * points, SYMBOL.search(body) is not None)
                for column, x in zip(found, (*row, hashlib.blake2b(body, digest_size=16).digest()), strict=True):
                    column.append(x)
            kinds = [pa.bool_()] * 4 + [pa.binary()]
            made = [pa.array(x, k) for x, k in zip(found, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=schema.names)

    return taken.mapInArrow(run, schema)


def with_copies(flags: DataFrame) -> DataFrame:
    """`flags` (stored) and a column E: a smaller id has the same text. False without an id."""
    digests = flags.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    found = attach(flags, store(digests.where("copies > 1")), "digest")
    return found.withColumn("E", F.coalesce(F.col("id") > F.col("first"), F.lit(False))).drop("first", "digest")


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "lang") -> DataFrame:
    """The interactions of five filters over `docs`, see `interactions` and `read_flags`.

    Filter E fails a text that a smaller id has too, in whatever part and whether removed or not.
    `labels` (doc_id, quality, toxic) gives the marks: good is a row of quality 1, toxic one of
    toxic 1, of any of an id's rows. Labels without an id, and ids without labels, mark nothing.
    Rows without an id count in their part, bear no mark and are copies of nothing. Rows that
    repeat an id count one by one and are not copies of each other. Other columns play no part.
    """
    flags = store(read_flags(docs, text, doc_id, part))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    marks = marks.where("good OR toxic")
    flagged = with_copies(flags)
    no = F.lit(False)
    nameless = flagged.where("id IS NULL").withColumns({"good": no, "toxic": no})
    named = flagged.where("id IS NOT NULL").join(marks, "id", "left")
    return interactions(named.unionByName(nameless), "ABCDE", ["good", "toxic"])
