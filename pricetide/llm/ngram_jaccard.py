"""N-gram Jaccard join with set-relation skipping, and the classes that its links form.

1. Every text becomes a set of hashed word n-grams. Equal sets are one node (with a weight).
2. A prefix of each set, in an order that puts frequent n-grams last, goes to an inverted index.
3. Nodes that share a prefix n-gram are dealt into chunks by their most frequent one. Within a
   chunk all overlaps are computed; those of a set that is much like an earlier one follow from
   that set's by looking at the few n-grams in which the two differ.
4. Index lists hold blocks of a chunk's postings of like size, with the least position: pairs of
   chunks whose blocks the size or position bound excludes are skipped, others are compared.
5. Links inside and between chunks give each set's number of links, and star edges from which
   connected components are found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pricetide.llm.common import (
    FOLD,
    IS_SPACE,
    discard,
    mix,
    slices,
    small_batches,
    store,
    utf8,
    window_hashes,
    word_hashes,
    word_places,
)
from pricetide.llm.substring_dedup import _filter_table, _slot


@dataclass(frozen=True)
class Settings:
    """width: words of an n-gram; num / den: least similarity; sketch_bits: counters of the
    sketch that orders n-grams; hot: estimated count from which an n-gram's postings are not
    gathered in one task; bucket_rows: postings aimed at for a task that looks for n-grams of
    several sets; chunk_sets and chunk_grams: sets and n-grams aimed at for a chunk."""

    width: int = 5
    num: int = 75
    den: int = 100
    sketch_bits: int = 20
    hot: int = 4096
    bucket_rows: int = 1_000_000
    chunk_sets: int = 1024
    chunk_grams: int = 1 << 19


SKETCH_PARTS = 64
#: Bytes of text whose sets are worked out at a time; they bound a Python worker's memory.
SET_BYTES = 1 << 18
_CLASS_BITS = 6
#: Slots for each node in the bit table that keeps other texts out of the shuffle, and its least and greatest size (powers of 2).
_SLOTS_PER_NODE, _LEAST_BITS, _MOST_BITS = 16, 16, 28


def text_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text.

    A text of fewer words is one n-gram of all its words; without words the set is empty.
    """
    data, offsets = utf8(texts)
    data = FOLD[data]
    starts, ends, words = word_places(~IS_SPACE[data], offsets)
    hashes = word_hashes(data, starts, ends)
    grams = window_hashes(hashes, width)
    out = []
    for a, b in zip(words[:-1].tolist(), words[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            out.append(window_hashes(hashes[a:b], b - a, seed=100 + b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_digest(grams: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers; the order of its members doesn't matter."""
    both = [mix(mix(grams ^ np.uint64(salt)).sum(dtype=np.uint64, keepdims=True)) for salt in (0x51ED270B, 0xA24BAED4)]
    return int(both[0].view(np.int64)[0]), int(both[1].view(np.int64)[0])


def prefix_size(n: np.ndarray | int, s: Settings) -> Any:
    """Members of which a similar set holds one at least: n - ceil(n * num / den) + 1."""
    return n - (n * s.num + s.den - 1) // s.den + (n > 0)


def in_order(grams: np.ndarray, classes: np.ndarray, bits: int) -> np.ndarray:
    """The set's members as sorted numbers, frequent ones last: a class and the hash below it."""
    kind = classes[(grams >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64)
    tokens = (kind << np.uint64(64 - _CLASS_BITS)) | (grams >> np.uint64(_CLASS_BITS))
    return np.sort(tokens)


def _read_sets(docs: DataFrame, doc_id: str, text: str, s: Settings) -> DataFrame:
    """A row (id, set, other, n) for each document, and each task's sketch in parts."""
    id_type = docs.schema[doc_id].dataType
    schema = T.StructType(
        [
            T.StructField("id", id_type),
            T.StructField("set", T.LongType()),
            T.StructField("other", T.LongType()),
            T.StructField("n", T.LongType()),
            T.StructField("part", T.IntegerType()),
            T.StructField("counts", T.BinaryType()),
        ]
    )
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << s.sketch_bits, np.int64)
        for batch in batches:
            for part in slices(batch, text, SET_BYTES):
                sets = text_sets(part.column(text), s.width)
                digests = [set_digest(x) for x in sets]
                every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                np.add.at(counts, (every >> np.uint64(64 - s.sketch_bits)).astype(np.intp), 1)
                rows = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(doc_id).cast(arrow.field("id").type),
                        pa.array([d[0] for d in digests], pa.int64()),
                        pa.array([d[1] for d in digests], pa.int64()),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.nulls(rows, pa.int32()),
                        pa.nulls(rows, pa.binary()),
                    ],
                    schema=arrow,
                )
        for number, piece in enumerate(np.split(np.minimum(counts, (1 << 31) - 1).astype(np.int32), SKETCH_PARTS)):
            yield pa.RecordBatch.from_pylist(
                [{"part": number, "counts": piece.tobytes()}], schema=arrow
            )

    return docs.select(doc_id, text).mapInArrow(run, schema)


def _classes(rows: DataFrame, s: Settings) -> np.ndarray:
    """A frequency class for each counter of the summed sketch; a fixed number of bytes.

    A counter stands out by what it has over the mean and four times its spread.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = np.frombuffer(counts.as_buffer(), np.int32)
                sums[number] = sums.get(number, 0) + values.astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
            ["part", "counts"],
        )

    parts = rows.where("part IS NOT NULL").select("part", "counts")
    total = np.zeros(1 << s.sketch_bits, np.int64)
    width = len(total) // SKETCH_PARTS
    for row in parts.repartition(SKETCH_PARTS, "part").mapInArrow(add, "part int, counts binary").collect():
        total[row["part"] * width : (row["part"] + 1) * width] = np.frombuffer(row["counts"], np.int64)
    mean = total.mean()
    over = np.maximum(0, total - mean - 4 * np.sqrt(mean))
    return np.minimum((1 << _CLASS_BITS) - 1, 2 * np.log2(1 + over)).astype(np.uint8)


def _postings(docs: DataFrame, text: str, classes: Any, buckets: int, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Two stored tables of prefix postings (token, set, n, pos, held) of tokens that several sets have.

    The first has the tokens that were gathered in buckets, the second the frequent ones.

    Tasks send their postings to buckets of tokens in packed rows, each set once. Postings of
    tokens that the sketch holds frequent skip the search for a second set, so that no bucket
    gets more of one token than the sketch's noise.
    """
    hot = np.uint64(int(2 * np.log2(1 + s.hot)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        order = classes.value
        emitted = 0
        for batch in batches:
            for part in slices(batch, text, SET_BYTES):
                tokens, names, sizes, owners, places = [], [], [], [], []
                for grams in text_sets(part.column(text), s.width):
                    if not len(grams):
                        continue
                    name = set_digest(grams)[0]
                    if name in seen:
                        continue
                    seen.add(name)
                    take = int(prefix_size(len(grams), s))
                    tokens.append(in_order(grams, order, s.sketch_bits)[:take])
                    owners.append(np.full(take, len(names), np.int32))
                    places.append(np.arange(take, dtype=np.int32))
                    names.append(name)
                    sizes.append(len(grams))
                if not tokens:
                    continue
                flat = np.concatenate(tokens)
                owner, place = np.concatenate(owners), np.concatenate(places)
                # Sets and sizes go once a row; numbers take two bytes where they fit.
                names, sizes = np.array(names, np.int64), np.array(sizes, np.int32)
                small = np.uint16 if max(len(names), int(sizes.max())) < 1 << 16 else np.int32
                bucket = (mix(flat) % np.uint64(buckets)).astype(np.int64)
                # Frequent tokens go in rows of their own that nothing has to meet.
                bucket[(flat >> np.uint64(64 - _CLASS_BITS)) >= hot] = -1
                by = np.argsort(bucket, kind="stable")
                edges = np.flatnonzero(np.diff(bucket[by], prepend=-2))
                rows = []
                for a, b in zip(edges, [*edges[1:], len(by)], strict=True):
                    where = by[a:b]
                    number = int(bucket[where[0]])
                    if number < 0:
                        emitted += 1
                        number = -1 - (hash((int(names[owner[where[0]]]), emitted)) & 0xFFFFFFFF)
                    used, at = np.unique(owner[where], return_inverse=True)
                    columns = (flat[where], names[used], sizes[used], at.astype(small), place[where].astype(small))
                    rows.append((number, *(c.tobytes() for c in columns)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64())]
                    + [pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 6)],
                    ["bucket", "token", "sets", "sizes", "owner", "pos"],
                )

    def unpack(row: dict) -> list[np.ndarray]:
        tokens = np.frombuffer(row["token"], np.int64)
        small = np.uint16 if len(row["pos"]) == 2 * len(tokens) else np.int32
        owner = np.frombuffer(row["owner"], small)
        sets, sizes = np.frombuffer(row["sets"], np.int64), np.frombuffer(row["sizes"], np.int32)
        return [tokens, sets[owner], sizes[owner], np.frombuffer(row["pos"], small).astype(np.int32)]

    def shared(table: pa.Table) -> pa.Table:
        columns = [np.concatenate(c) for c in zip(*map(unpack, table.to_pylist()), strict=True)]
        held = None
        if table.column(0)[0].as_py() >= 0:
            by = np.lexsort((columns[1], columns[0]))
            columns = [c[by] for c in columns]
            fresh = np.ones(len(by), bool)
            fresh[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
            columns = [c[fresh] for c in columns]
            _, number, count = np.unique(columns[0], return_inverse=True, return_counts=True)
            several = count[number] > 1
            columns, held = [c[several] for c in columns], count[number][several]
        held = pa.nulls(len(columns[0]), pa.int64()) if held is None else pa.array(held, pa.int64())
        return pa.table([*map(pa.array, columns), held], names=["token", "set", "n", "pos", "held"])

    packed = docs.select(text).mapInArrow(
        pack, "bucket long, token binary, sets binary, sizes binary, owner binary, pos binary"
    )
    found = store(packed.groupBy("bucket").applyInArrow(shared, "token long, set long, n int, pos int, held long"))
    # Postings that no bucket gathered may repeat, once for each task that has the set.
    frequent = store(_with_count(found.where("held IS NULL").drop("held").distinct()))
    return found, frequent


def _band() -> F.Column:
    """A number that sizes within a twentieth of each other mostly share."""
    return F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.05)))


def _with_count(postings: DataFrame) -> DataFrame:
    """Postings of tokens that several sets have, and how many have them (`held`)."""
    held = postings.groupBy("token").agg(F.count("*").alias("held")).where("held > 1")
    return postings.drop("held").join(held, "token")


def _fewest(low: F.Column, high: F.Column, other_low: F.Column, other_high: F.Column, s: Settings) -> F.Column:
    """Prefix tokens that linked sets of sizes in two ranges have in common at least.

    Sets x and y need num / (num + den) of both sizes in common. What they have in common up to
    the end of the prefix that ends first is in both prefixes; beyond it that set has fewer than
    num / den of its members left. The difference is least for the largest of one range with
    the smallest of the other.
    """
    share, rest = s.num / (s.num + s.den), s.num / s.den
    ends = [(high, F.greatest(other_low, high * rest)), (F.greatest(low, other_high * rest), other_high)]
    return F.least(*(share * (x + y) - rest * F.greatest(x, y) for x, y in ends)) - 1e-6


def _linkable(postings: DataFrame, s: Settings) -> DataFrame:
    """The sets that may be linked with any set at all.

    The blocks of an index list are its postings of like size, with the least position. Blocks
    that the size bound excludes are skipped for a posting. A set is kept if for sets of some
    size it has as many tokens as a link takes, among them one that the position bound allows to
    be the first in common.
    """
    blocks = postings.groupBy("token", _band().alias("band")).agg(
        F.count("*").alias("sets"),
        F.min("n").alias("low"),
        F.max("n").alias("high"),
        F.max(F.col("n") - F.col("pos")).alias("rest"),
    )
    n = F.col("n")
    smaller = F.greatest(F.col("low"), n * (s.num / s.den))
    met = postings.withColumn("own", _band()).join(blocks, "token").where(
        ((F.col("sets") > 1) | (F.col("band") != F.col("own")))
        & (s.den * F.col("high") >= s.num * n)
        & (s.den * n >= s.num * F.col("low"))
    )
    # An overlap of num / (num + den) of both sizes must fit into what follows the first token.
    first = (s.num + s.den) * F.least(n - F.col("pos"), F.col("rest")) >= s.num * (n + smaller) - 1e-6
    counted = met.groupBy("set", "band").agg(
        F.count("*").alias("tokens"),
        F.max(first).alias("first"),
        F.first("n").alias("n"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )
    kept = counted.where(F.col("first") & (F.col("tokens") >= _fewest(n, n, F.col("low"), F.col("high"), s)))
    return kept.select("set").distinct()


def _chunk_pairs(postings: DataFrame, s: Settings) -> DataFrame:
    """Stored pairs (one, band_one, two, band_two) of chunks whose sets of these bands may be linked.

    Blocks of the index lists are a chunk's postings of like size. They are compared token by
    token under the size bound, and the tokens of a pair are counted; the position bound must
    allow one of them to be the first in common.
    """
    blocks = postings.groupBy("token", "chunk", _band().alias("band")).agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("pos")).alias("rest")
    )
    several = blocks.groupBy("token").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).where("a < b")
    blocks = store(blocks.join(several.select("token"), "token"))
    left, right = blocks.alias("l"), blocks.alias("r")
    low, other_low = F.col("l.low"), F.col("r.low")
    least = F.greatest(low, other_low * (s.num / s.den)) + F.greatest(other_low, low * (s.num / s.den))
    alike = (
        (F.col("l.chunk") < F.col("r.chunk"))
        & (s.den * F.col("l.high") >= s.num * other_low)
        & (s.den * F.col("r.high") >= s.num * low)
    )
    first = (s.num + s.den) * F.least("l.rest", "r.rest") >= s.num * least - 1e-6
    counted = (
        left.join(right, F.col("l.token") == F.col("r.token"))
        .where(alike)
        .groupBy(
            F.col("l.chunk").alias("one"), F.col("l.band").alias("band_one"), F.col("r.chunk").alias("two"), F.col("r.band").alias("band_two")
        )
        .agg(
            F.count("*").alias("tokens"),
            F.max(first).alias("first"),
            F.min(low).alias("low"),
            F.max("l.high").alias("high"),
            F.min(other_low).alias("other_low"),
            F.max("r.high").alias("other_high"),
        )
    )
    fewest = _fewest(F.col("low"), F.col("high"), F.col("other_low"), F.col("other_high"), s)
    pairs = store(counted.where(F.col("first") & (F.col("tokens") >= fewest)).select("one", "band_one", "two", "band_two"))
    discard(blocks)
    return pairs


def _fetch_sets(docs: DataFrame, nodes: DataFrame, doc_id: str, text: str, classes: Any, s: Settings) -> DataFrame:
    """The nodes (id, set and any others) with all their tokens, worked out again from their texts.

    Most texts are no node: a bit table of the nodes' ids keeps them out of the shuffle.
    """
    carried = nodes.columns
    bits = min(_MOST_BITS, max(_LEAST_BITS, (_SLOTS_PER_NODE * nodes.count()).bit_length()))
    table = docs.sparkSession.sparkContext.broadcast(_filter_table(nodes.select(F.xxhash64("id").alias("h1")), bits))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = table.value
        for batch in batches:
            slot = _slot(batch.column("slot").to_numpy(), bits)
            keep = (held[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1
            yield batch.select(["id", "text"]).filter(pa.array(keep, pa.bool_()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = classes.value
        for batch in batches:
            for part in slices(batch, "text", SET_BYTES):
                sets = text_sets(part.column("text"), s.width)
                right = [set_digest(x)[0] == name for x, name in zip(sets, part.column("set").to_pylist(), strict=True)]
                keep = pa.array(right, pa.bool_())
                tokens = [in_order(x, order, s.sketch_bits).tobytes() for x, ok in zip(sets, right, strict=True) if ok]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c).filter(keep) for c in carried] + [pa.array(tokens, pa.binary())],
                    [*carried, "tokens"],
                )

    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    texts = texts.withColumn("slot", F.xxhash64("id")).mapInArrow(near, texts.schema)
    schema = T.StructType([*nodes.schema.fields, T.StructField("tokens", T.BinaryType())])
    # A broadcast would put both Python steps into one stage, and so two workers into each task,
    # which an executor then keeps; with a shuffle between them a task has one.
    return texts.join(nodes.hint("merge"), "id").mapInArrow(run, schema)


def overlaps(sets: list[np.ndarray], s: Settings) -> Iterator[tuple[int, np.ndarray]]:
    """For each set, the size of its overlap with every set.

    An inverted index of tokens that several of the sets have gives a set's overlaps. Those of
    a set whose overlap with an earlier pivot makes it a similar one are the pivot's, less
    those by the tokens that only the pivot has, plus those by the tokens that only it has.
    """
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    by = np.argsort(flat, kind="stable")
    _, number, count = np.unique(flat[by], return_inverse=True, return_counts=True)
    # Tokens get numbers; lists of tokens that only one set has are never needed.
    first = np.concatenate([[0], np.cumsum(count)])
    lists = owner[by]
    numbers = np.empty(len(flat), np.int64)
    numbers[by] = number
    at = np.concatenate([[0], np.cumsum(sizes)])
    common = [x[count[x] > 1] for x in (numbers[at[i] : at[i + 1]] for i in range(len(sets)))]

    def met(tokens: np.ndarray) -> np.ndarray:
        lengths = count[tokens]
        ends = np.cumsum(lengths)
        where = np.repeat(first[tokens] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(lists[where], minlength=len(sets))

    pivot = np.full(len(sets), -1)
    like = np.zeros(len(sets))
    known: dict[int, np.ndarray] = {}
    for x in range(len(sets)):
        if pivot[x] >= 0:
            p = int(pivot[x])
            mine, theirs = common[x], common[p]
            row = known[p] - met(np.setdiff1d(theirs, mine, True)) + met(np.setdiff1d(mine, theirs, True))
            # A token that only this set has is in no list, but counts for its own overlap.
            row[x] = sizes[x]
        else:
            row = met(common[x])
            row[x] = sizes[x]
            known[x] = met(common[x])
            with np.errstate(invalid="ignore"):
                share = row / np.maximum(1, sizes + sizes[x] - row)
            closer = (share * s.den >= s.num) & (share > like)
            pivot[closer], like[closer] = x, share[closer]
        yield x, row


def solve(ids: list[Any], weights: np.ndarray, sets: list[np.ndarray], sides: np.ndarray | None, s: Settings) -> tuple[list[Any], np.ndarray]:
    """The least id that each set is linked to directly or through others, and its links' weight.

    With `sides`, only pairs of different sides count.
    """
    sizes = np.array([len(x) for x in sets])
    parent = list(range(len(sets)))
    links = np.zeros(len(sets), np.int64)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for x, row in overlaps(sets, s):
        linked = s.den * row >= s.num * (sizes + sizes[x] - row)
        linked[x] = False
        if sides is not None:
            linked &= sides != sides[x]
        links[x] = weights[linked].sum()
        for y in np.flatnonzero(linked[:x]).tolist():
            a, b = root(x), root(y)
            if a != b:
                parent[a] = b
    least: dict[int, Any] = {}
    for i, name in enumerate(ids):
        r = root(i)
        if r not in least or name < least[r]:
            least[r] = name
    return [least[root(i)] for i in range(len(ids))], links


def _solve_groups(members: DataFrame, keys: list[str], s: Settings) -> DataFrame:
    """A row (id, root, set, links) for each set of each group; column `side` may split a group."""
    id_field = members.schema["id"]
    schema = T.StructType(
        [id_field, T.StructField("root", id_field.dataType), T.StructField("set", T.LongType()), T.StructField("links", T.LongType())]
    )
    two = "side" in members.columns

    def run(table: pa.Table) -> pa.Table:
        rows = {}
        for at, name in enumerate(table.column("set").to_pylist()):
            rows.setdefault(name, at)  # a repeated row of the same text adds nothing
        table = table.take(sorted(rows.values()))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("tokens")]
        ids, names = table.column("id").to_pylist(), table.column("set")
        sides = np.array(table.column("side").to_pylist()) if two else None
        weights = np.array(table.column("weight").to_pylist(), np.int64)
        roots, links = solve(ids, weights, sets, sides, s)
        kind = table.schema.field("id").type
        return pa.table(
            [pa.array(ids, kind), pa.array(roots, kind), names, pa.array(links, pa.int64())],
            names=["id", "root", "set", "links"],
        )

    return members.groupBy(*keys).applyInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): a row (id, component) for each end, with the least id.

    Rounds of large-star and small-star; each is stored, and they end when the edges stay.
    """
    edges = store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            break
        state = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        before, edges = edges, store(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        discard(before)
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def jaccard_classes(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", settings: Settings | None = None
) -> DataFrame:
    """A row (id, n_shingles, component_id, n_links) for each row of `docs`.

    Words are runs of characters other than white space in ASCII, A-Z lower-cased; the set of a
    text is that of its word n-grams, and one of all its words if it has fewer. Two rows are
    linked if num / den of the union of their sets is common to both. `component_id` is the
    least id that links reach, `n_links` the number of rows linked directly.

    A null or empty text, or one of white space, has an empty set and is linked with nothing.
    A row without an id keeps its set's size; it is linked with nothing and has no component.
    Rows that repeat an id are rows of their own, but sets whose least ids are the same count
    as linked. Sets are compared by 58-bit hashes of their members, and told apart by 64 bits
    (128 for equal texts). Other columns of `docs` play no part.
    """
    s = settings or Settings()
    spark = docs.sparkSession
    small_batches(spark)
    rows = store(_read_sets(docs, doc_id, text, s))
    classes = spark.sparkContext.broadcast(_classes(rows, s))
    sized = rows.where("part IS NULL").drop("part", "counts")
    equal = (
        sized.where("id IS NOT NULL AND n > 0")
        .groupBy("set", "other", "n")
        .agg(F.min("id").alias("id"), F.count("*").alias("weight"))
    )
    taken = F.col("n") - F.ceil(F.col("n") * s.num / s.den) + 1
    total = sized.agg(F.sum(taken)).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, -(-int(total) // s.bucket_rows))
    usable = docs.where(F.col(doc_id).isNotNull())
    gathered, frequent = _postings(usable, text, classes, buckets, s)
    postings = gathered.where("held IS NOT NULL").unionByName(frequent)

    # A step's shuffle files go when it is stored, so the postings go through two shorter steps.
    linkable = store(_linkable(postings, s))
    useful = store(_with_count(postings.join(linkable, "set", "left_semi")))
    discard(gathered, frequent, linkable)
    key = useful.groupBy("set").agg(F.max(F.struct("held", "token"))["token"].alias("key"), F.first("n").alias("n"))
    sizes = key.groupBy("key").agg(F.count("*").alias("sets"), F.sum("n").alias("grams"))
    parts = F.greatest(F.ceil(F.col("sets") / s.chunk_sets), F.ceil(F.col("grams") / s.chunk_grams))
    chunk = key.join(sizes, "key").select(
        "set", _band().alias("band"), F.xxhash64("key", F.pmod(F.xxhash64("set"), parts)).alias("chunk")
    )
    chunk = store(chunk)
    # Stored, the nodes are known to be few beside the texts before those are dealt to meet them.
    nodes = store(equal.join(chunk, "set").select("id", "set", "weight", "band", "chunk"))
    members = store(_fetch_sets(docs, nodes, doc_id, text, classes, s))
    discard(nodes)
    inside = store(_solve_groups(members, ["chunk"], s))

    pairs = _chunk_pairs(useful.join(chunk.select("set", "chunk"), "set"), s)
    discard(useful, chunk)
    one = pairs.select("one", "two", F.col("one").alias("chunk"), F.col("band_one").alias("band"))
    two = pairs.select("one", "two", F.col("two").alias("chunk"), F.col("band_two").alias("band"))
    across = one.unionByName(two).distinct().join(members, ["chunk", "band"])
    across = across.withColumn("side", F.col("chunk") == F.col("one")).drop("chunk", "band")
    between = store(_solve_groups(across, ["one", "two"], s))
    discard(members, pairs)

    linked = inside.unionByName(between)
    counts = linked.groupBy("set").agg(F.sum("links").alias("links"))
    found = components(linked.select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = (
        equal.join(counts, "set", "left")
        .join(found, "id", "left")
        .select(
            "set",
            "other",
            "n",
            F.coalesce("component", "id").alias("component"),
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"),
        )
    )
    out = sized.join(named, ["set", "other", "n"], "left")
    has_id = F.col("id").isNotNull()
    return out.select(
        F.col("id").alias(doc_id),
        F.col("n").alias("n_shingles"),
        F.when(has_id, F.coalesce("component", "id")).alias("component_id"),
        F.when(has_id, F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
    )
