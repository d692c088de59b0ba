"""SimHash near-duplicates by covering locality-sensitive hashing.

1. A text's fingerprint has a bit set where over half its shingles' 64-bit hashes have it set.
2. Distinct fingerprints are nodes. Bit positions get non-zero vectors of radius + 1 bits; the
   mask of a non-zero vector v keeps the positions whose vector has an odd product with v. Any
   `radius` positions leave some v with even products only, so two fingerprints that differ in
   that many bits agree under some mask: the 2^(radius + 1) - 1 tables miss no pair.
3. Buckets of a table with more nodes than a task should compare are split by masks over the bits
   that are still free, by the same rule, until they are small; three levels leave few free bits.
4. Links inside buckets become a few edges each, and connected components follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide.llm.common import attach, small_batches, store
from pricetide.llm.ngram_jaccard import components

BITS = 64
#: Shingles whose bits are counted at a time, and bytes of a text that are split at a time.
COUNT_AT_ONCE = 1 << 16
SPLIT_BYTES = 1 << 20
#: Nodes of a bucket that are compared in one task.
BUCKET = 512


def shingles(text: bytes, width: int) -> Iterator[list[int]]:
    """Hashes (XXH64, seed 42) of all runs of `width` words, a list for each part of the text."""
    digest = xxhash.xxh64_intdigest
    text = text.lower()
    carried: list[bytes] = []
    rest = b""
    made = False
    for at in range(0, max(len(text), 1), SPLIT_BYTES):
        piece = rest + text[at : at + SPLIT_BYTES]
        words = piece.split()
        last = at + SPLIT_BYTES >= len(text)
        rest = b"" if last or not words or piece[-1:].isspace() else words.pop()
        words = carried + words
        if len(words) >= width:
            made = True
            # The words lie in one string, so a shingle is a slice of it.
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
            yield [digest(joined[a:b], 42) for a, b in spans]
        elif last and words and not made:
            yield [digest(b" ".join(words), 42)]
        carried = words[max(0, len(words) - width + 1) :]


def fingerprint(text: bytes, width: int) -> int:
    """The 64 bits of a text; zero without words."""
    total, n = np.zeros(BITS, np.int64), 0
    for hashes in shingles(text, width):
        for at in range(0, len(hashes), COUNT_AT_ONCE):
            some = np.array(hashes[at : at + COUNT_AT_ONCE], "<u8")
            bits = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total += bits.sum(0, dtype=np.int64)
        n += len(hashes)
    return sum(1 << i for i in np.flatnonzero(2 * total > n).tolist())


def covering_masks(free: int, radius: int) -> list[int]:
    """Masks over the set bits of `free`: any `radius` of them lie outside of some mask."""
    positions = [i for i in range(BITS) if free >> i & 1]
    vectors = (1 << radius + 1) - 1
    vector = {p: at % vectors + 1 for at, p in enumerate(positions)}
    return [
        sum(1 << p for p in positions if (vector[p] & v).bit_count() % 2)
        for v in range(1, vectors + 1)
    ]


def mask_levels(radius: int, levels: int) -> list[list[int]]:
    """For each level, the masks of all paths of tables down to it, in order of the paths."""
    out, fixed = [], [0]
    for _ in range(levels):
        fixed = [had | m for had in fixed for m in covering_masks(~had & (1 << BITS) - 1, radius)]
        out.append(fixed)
    return out


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> BITS - 1 else x


def bucket_roots(members: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint, the place of the first one that links reach inside the bucket."""
    near = np.bitwise_count(members[:, None] ^ members[None, :]) <= radius
    root = np.arange(len(members))
    while True:
        least = np.where(near, root[None, :], len(members)).min(1)
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _bucket_edges(buckets: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) that join the linked members of each bucket's array."""
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("members")
            offsets = column.offsets.to_numpy()
            values = column.values.to_numpy(zero_copy_only=False)
            found = []
            for first, last in zip(offsets, offsets[1:], strict=False):
                members = np.sort(values[first:last])
                root = bucket_roots(members.view(np.uint64), radius)
                linked = root != np.arange(len(root))
                found.append(np.stack([members[linked], members[root[linked]]]))
            edges = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(edges[0]), pa.array(edges[1])], names=["a", "b"])

    return buckets.select("members").mapInArrow(run, schema)


def near_links(nodes: DataFrame, radius: int = 2, bucket: int = BUCKET, levels: int = 3) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (`nodes`, column fp) that differ in few bits.

    The edges join what links join: fingerprints of one bucket that links connect form a star.
    The last level's buckets are compared whatever their size; with 64 bits, a radius of 2 and
    three levels they hold at most 64 fingerprints.
    """
    rows = nodes.select(F.lit(0).alias("path"), "fp")
    edges = None
    for level, masks in enumerate(mask_levels(radius, levels)):
        tables = (1 << radius + 1) - 1
        masked = F.lit([_signed(m) for m in masks])
        table = F.explode(F.sequence(F.lit(0), F.lit(tables - 1))).alias("table")
        dealt = rows.select("path", "fp", table).select((F.col("path") * tables + F.col("table")).alias("path"), "fp")
        dealt = dealt.withColumn("key", F.col("fp").bitwiseAND(F.element_at(masked, F.col("path") + 1)))
        sizes = dealt.groupBy("path", "key").agg(
            F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")
        )
        sizes = store(sizes.where("n > 1"))
        near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
        pairs = sizes.where("n = 2").where(near).select("a", "b")
        last = level + 1 == levels
        few = F.lit(True) if last else F.col("n") <= bucket
        crowd = sizes.where("n > 2").select("path", "key", few.alias("few"))
        if crowd.isEmpty():
            found = pairs
        else:
            crowded = dealt.join(crowd, ["path", "key"])
            grouped = crowded.where("few").groupBy("path", "key").agg(F.collect_list("fp").alias("members"))
            found = pairs.unionByName(_bucket_edges(grouped, radius))
        edges = found if edges is None else edges.unionByName(found)
        if last or sizes.where(F.col("n") > bucket).isEmpty():
            break
        rows = store(crowded.where("NOT few").select("path", "fp"))
    return edges


def simhash_classes(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 3, radius: int = 2, bucket: int = BUCKET
) -> DataFrame:
    """A row (id, fingerprint, component_id) for each row of `docs`; fingerprint is a long.

    Words are runs of characters other than white space in ASCII, A-Z lower-cased; shingles are
    runs of `width` words joined by one space, repeats included, or all words if there are fewer.
    Two rows are linked if their fingerprints differ in at most `radius` bits; `component_id` is
    the least id that links reach. A null, empty or blank text has the fingerprint zero and is
    linked like any other. A row without an id keeps its fingerprint, is linked with nothing and
    has no component. Rows that repeat an id are rows of their own. Other columns play no part.
    """
    small_batches(docs.sparkSession)
    taken = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    schema = T.StructType([taken.schema["id"], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((fingerprint(x.as_py(), width) for x in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made.view(np.int64))], names=["id", "fp"])

    rows = store(taken.mapInArrow(run, schema))
    named = rows.where("id IS NOT NULL").groupBy("fp")
    nodes = store(named.agg(F.min("id").alias("first"), F.count("*").alias("copies")))
    found = components(near_links(nodes, radius, bucket)).withColumnRenamed("id", "fp")
    linked = store(nodes.join(found, "fp"))
    heads = linked.groupBy("component").agg(F.min("first").alias("least"), F.count("*").alias("copies"))
    named = attach(linked.select("fp", "component"), store(heads), "component").select("fp", "least")
    classes = nodes.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("class"), "copies")
    return attach(rows, store(classes), "fp").select(
        F.col("id").alias(doc_id),
        F.col("fp").alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("class")).alias("component_id"),
    )
