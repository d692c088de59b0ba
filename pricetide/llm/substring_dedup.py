"""Substring dedup: content-defined chunks, deduplicated by digest across documents.

A gear hash of the last 32 bytes decides where chunks end, so what is inserted or cut before a
passage moves no boundary inside it. A chunk runs from the end before to its own, and is at least
32 bytes long; chunks that texts with other ids have are found by one aggregation over digests.
Each carries the text up to its neighbours' far ends, and by comparing that with the source's a
repeated passage is followed into the chunks that it begins and ends in. What is covered and
long enough is a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from pricetide.llm.common import HOT_KEYS, IS_SPACE, mix, odd_constants, slices, small_batches, store, utf8, word_places

_GEAR = (odd_constants(256, 29) >> np.uint64(32)).astype(np.uint32)
_IS_LEAD = (np.arange(256) & 0xC0) != 0x80
_INNER_BYTES = bytes(range(0x80, 0xC0))
FILTER_PARTS = 16
#: Bits of the filter table for each repeated chunk, and the least and greatest size as a power of 2.
FILTER_SPACE, FILTER_LEAST, FILTER_MOST = 16, 16, 28
#: Least bytes of a chunk, and bytes before its end within which no other chunk may end.
LEAST, APART = 32, 3
#: Bytes on each side of a chunk that are carried at most.
BESIDE = 4096


@dataclass(frozen=True)
class Settings:
    """chunk_bytes: bytes from one end of a chunk to the next, on average; least_words: words that
    a repeated passage begins at least; filter_bits: bits (as a power of 2) of the table by which
    chunks that occur once are left out of the join, by default as the number of repeated chunks
    asks for. A smaller table only filters less."""

    chunk_bytes: int = 24
    least_words: int = 20
    filter_bits: int | None = None


def gear_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The gear hash at each byte: that of the last 32 bytes of its text, or fewer at its start."""
    hashes = _GEAR[data]
    first = np.repeat(offsets[:-1], np.diff(offsets))
    place = (np.arange(len(data)) - first).astype(np.int64)
    for width in (1, 2, 4, 8, 16):
        if len(data) <= width:
            break
        older = hashes[:-width] << np.uint32(width)
        hashes = hashes.copy()
        hashes[width:] += np.where(place[width:] >= width, older, np.uint32(0))
    return hashes


def chunk_ends(data: np.ndarray, offsets: np.ndarray, chunk_bytes: int) -> np.ndarray:
    """Where chunks end: after bytes whose hash is small, between characters, and at text ends."""
    cut = gear_hashes(data, offsets) < np.uint32((1 << 32) // chunk_bytes)
    cut[:-1] &= _IS_LEAD[data[1:]]
    cut[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
    return np.flatnonzero(cut) + 1


@dataclass
class Chunks:
    """Chunks of consecutive texts: byte starts and ends, the texts' numbers, digest halves.

    `left` and `right` are how far the text beside them is carried.
    """

    starts: np.ndarray
    ends: np.ndarray
    text_of: np.ndarray
    left: np.ndarray
    right: np.ndarray
    h1: np.ndarray
    h2: np.ndarray


def chunks(data: np.ndarray, offsets: np.ndarray, s: Settings) -> Chunks:
    """All chunks of the texts.

    Ends close behind another one are none, so that a run of one byte is a single chunk. A chunk
    of less than LEAST bytes begins that much before its end; one that its text has no room for
    is left out.
    """
    ends = chunk_ends(data, offsets, s.chunk_bytes)
    text_of = np.searchsorted(offsets, ends, side="left") - 1
    last = ends == offsets[text_of + 1]
    close = np.zeros(len(ends), bool)
    close[1:] = (np.diff(ends) <= APART) & (text_of[1:] == text_of[:-1]) & ~last[1:]
    ends, text_of = ends[~close], text_of[~close]
    first, stop = offsets[text_of], offsets[text_of + 1]
    before, far, after = first.copy(), first.copy(), stop.copy()
    same = text_of[1:] == text_of[:-1]
    before[1:][same] = ends[:-1][same]
    far[1:] = np.where(same, before[:-1], far[1:])
    after[:-1][same] = ends[1:][same]
    starts = np.minimum(before, ends - LEAST)
    keep = starts >= first
    # In the first 32 bytes of a passage ends depend on what stands before it, so `far` may be one
    # of these, and the passage begins up to that much before it.
    far = np.maximum(first, far - LEAST - APART)
    starts, ends, text_of, far, after = (x[keep] for x in (starts, ends, text_of, far, after))
    for _ in range(3):  # a chunk begins with a character
        starts = starts + ~_IS_LEAD[data[starts]] if len(starts) else starts
    left = np.maximum(np.minimum(far, starts), starts - BESIDE)
    right = np.minimum(after, ends + BESIDE)
    body = data.tobytes()
    raw = b"".join([xxhash.xxh3_128_digest(body[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    digests = np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 2)
    return Chunks(starts, ends, text_of, left, right, digests[:, 0].view(np.int64), digests[:, 1].view(np.int64))


NUMBERS = ["at", "points", "end_points", "words", "end_words"]


def _described(data: np.ndarray, offsets: np.ndarray, found: Chunks, keep: np.ndarray) -> dict[str, Any]:
    """Of some chunks: `at`, the byte of their text at which they begin; code points and words that
    begin before their start and end; whether a word goes on at their end (`inside`); the text
    beside them; and whether `left` reaches the text's start (`whole`)."""
    starts, ends, left, right = (x[keep] for x in (found.starts, found.ends, found.left, found.right))
    first = offsets[found.text_of[keep]]
    begins = np.zeros(len(data), bool)
    begins[word_places(~IS_SPACE[data], offsets)[0]] = True
    points = np.concatenate([[0], np.cumsum(_IS_LEAD[data])])
    words = np.concatenate([[0], np.cumsum(begins)])
    body = data.tobytes()
    return {
        "at": starts - first,
        "points": points[starts] - points[first],
        "end_points": points[ends] - points[first],
        "words": words[starts] - words[first],
        "end_words": words[ends] - words[first],
        "inside": ~IS_SPACE[data[ends - 1]] if len(ends) else np.zeros(0, bool),
        "whole": left == first,
        "left": [body[a:b] for a, b in zip(left.tolist(), starts.tolist(), strict=True)],
        "right": [body[a:b] for a, b in zip(ends.tolist(), right.tolist(), strict=True)],
    }


def _alike(a: bytes, b: bytes, order: str) -> int:
    """Bytes in which two equally long ones agree at their starts ("big") or ends ("little")."""
    differ = int.from_bytes(a, order) ^ int.from_bytes(b, order)
    return len(a) - (differ.bit_length() + 7) // 8


def _word_count(text: bytes, goes_on: bool) -> int:
    """Words that begin in `text`; `goes_on` if a word that began before may reach into it."""
    return len(text.split()) - (goes_on and not text[:1].isspace() and text != b"")


def reach_left(left: bytes, source_left: bytes, whole: bool) -> tuple[int, int]:
    """Code points and words of the end of `left` that `source_left` ends with too.

    No character is cut. Unless `left` is all there is before (`whole`), its first byte only tells
    whether a word goes on behind it.
    """
    n = min(len(left), len(source_left))
    n = _alike(left[len(left) - n :], source_left[len(source_left) - n :], "little")
    n = min(n, len(left) if whole else max(0, len(left) - 1))
    while n and left[len(left) - n] & 0xC0 == 0x80:
        n -= 1
    if not n:
        return 0, 0
    tail, ahead = left[len(left) - n :], left[: len(left) - n]
    return len(tail.translate(None, _INNER_BYTES)), _word_count(tail, bool(ahead) and not ahead[-1:].isspace())


def reach_right(right: bytes, source_right: bytes, inside: bool) -> tuple[int, int]:
    """Code points and words of the start of `right` that `source_right` starts with too."""
    n = min(len(right), len(source_right))
    n = _alike(right[:n], source_right[:n], "big")
    while n and n < len(right) and right[n] & 0xC0 == 0x80:
        n -= 1
    head = right[:n]
    return len(head.translate(None, _INNER_BYTES)), _word_count(head, inside)


def _repeated(docs: DataFrame, doc_id: str, text: str, s: Settings) -> DataFrame:
    """Digests (h1, h2) of chunks that several ids have, the least of these (first_id), and how often they occur (copies)."""
    id_type = docs.schema[doc_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                found = chunks(*utf8(part.column(text)), s)
                ids = part.column(doc_id).take(pa.array(found.text_of))
                yield pa.RecordBatch.from_arrays([pa.array(found.h1), pa.array(found.h2), ids], ["h1", "h2", "id"])

    schema = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("id", id_type)])
    every = docs.select(doc_id, text).mapInArrow(run, schema)
    # One row for each digest and task reaches the shuffle, so a chunk of a third of all texts is light.
    ranges = every.groupBy("h1", "h2").agg(
        F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("copies")
    )
    return ranges.where("first_id < last_id").drop("last_id")


def _slot(h1: np.ndarray, bits: int) -> np.ndarray:
    return (mix(h1.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _filter_table(repeated: DataFrame, width_bits: int) -> np.ndarray:
    """A bit for each hash slot that a repeated digest has; 2 ** width_bits bits in all."""
    size = 1 << width_bits

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for batch in batches:
            bits[_slot(batch.column(0).to_numpy(), width_bits)] = True
        packed = np.split(np.packbits(bits), FILTER_PARTS)
        rows = [(n, p.tobytes()) for n, p in enumerate(packed) if p.any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "bits"]
        )

    def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, bits in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = np.frombuffer(bits.as_buffer(), np.uint8)
                held[number] = held[number] | values if number in held else values
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["part", "bits"]
        )

    parts = repeated.select("h1").mapInArrow(mark, "part int, bits binary")
    table = np.zeros(size // 8, np.uint8)
    width = len(table) // FILTER_PARTS
    for row in parts.repartition(FILTER_PARTS, "part").mapInArrow(either, "part int, bits binary").collect():
        table[row["part"] * width : (row["part"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return table


def _with_sources(matched: DataFrame, repeated: DataFrame) -> DataFrame:
    """The later documents' chunks with the text beside the same chunk in its source.

    Chunks that make up more than 1 / HOT_KEYS of the rows are joined by a broadcast of fewer than
    HOT_KEYS sources, so that none of them is gathered in a task.
    """
    key = ["h1", "h2"]

    def sources(rows: DataFrame) -> DataFrame:
        best = rows.where("id = first_id").groupBy(*key).agg(F.min(F.struct("row", "at", "left", "right")).alias("source"))
        return best.select(*key, F.col("source.left").alias("source_left"), F.col("source.right").alias("source_right"))

    hot = F.broadcast(repeated.where(F.col("copies") * HOT_KEYS > matched.count()).select(*key))
    later = matched.where("first_id < id")
    often = later.join(F.broadcast(sources(matched.join(hot, key, "left_semi"))), key)
    seldom = later.join(hot, key, "left_anti").join(sources(matched.join(hot, key, "left_anti")), key)
    return often.unionByName(seldom)


def repeated_passages(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", settings: Settings | None = None
) -> DataFrame:
    """Passages that an earlier document has too: a row for each stretch of repeated text.

    Columns: `doc_id`, `start` and `end` (code points, end exclusive), `n_words`, and
    `source_ids`, sorted: of the least ids of texts that have the stretch's chunks, those that
    account for `least_words` of its words, or for the most; a word that several of these have
    counts for the smallest. Chunks are equal if their 128-bit digests are. A chunk counts as
    repeated in all documents that have it but the one of least id, and only if documents of
    different ids have it. On both sides of it the text is compared byte by byte with that
    document's (where it has the chunk more than once: at its first place), to the far ends of
    both texts' neighbouring chunks and over `BESIDE` bytes at most. What is equal, joined where
    it overlaps or touches, is a row if `least_words` words begin in it. So a passage is
    reported to its true ends; one that holds no whole chunk isn't found, and the ends can fall
    short where the only chunks near them belong to other documents of smaller ids.

    Null and empty texts, and those of less than 32 bytes, have no chunks; rows without an id are
    left out, as they can neither be named nor kept; rows that repeat an id are one document
    here, and their stretches are those of each row. Other columns of `docs` play no part.
    """
    s = settings or Settings()
    id_type = docs.schema[doc_id].dataType
    arrow_id = to_arrow_type(id_type)
    usable = docs.where(F.col(doc_id).isNotNull()).select(doc_id, text)
    small_batches(docs.sparkSession)
    repeated = store(_repeated(usable, doc_id, text, s))
    width = s.filter_bits or min(FILTER_MOST, max(FILTER_LEAST, (FILTER_SPACE * repeated.count()).bit_length()))
    table = usable.sparkSession.sparkContext.broadcast(_filter_table(repeated, width))
    flags, sides = ["inside", "whole"], ["left", "right"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for batch in batches:
            for part in slices(batch, text):
                data, offsets = utf8(part.column(text))
                found = chunks(data, offsets, s)
                slot = _slot(found.h1, width)
                keep = (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1
                columns = _described(data, offsets, found, keep)
                text_of = found.text_of[keep]
                ids = part.column(doc_id).cast(arrow_id).take(pa.array(text_of))
                digest = [xxhash.xxh3_64_intdigest((v.as_py() or "").encode()) >> 1 for v in part.column(text)]
                which = np.array(digest, np.int64)[text_of]
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(x) for x in (which, found.h1[keep], found.h2[keep]))]
                    + [pa.array(columns[c].astype(np.int32)) for c in NUMBERS]
                    + [pa.array(columns[c]) for c in flags]
                    + [pa.array(columns[c], pa.binary()) for c in sides],
                    ["id", "row", "h1", "h2", *NUMBERS, *flags, *sides],
                )

    longs = [T.StructField(c, T.LongType()) for c in ("row", "h1", "h2")]
    kinds = [T.StructField(c, T.IntegerType()) for c in NUMBERS] + [T.StructField(c, T.BooleanType()) for c in flags]
    kinds += [T.StructField(c, T.BinaryType()) for c in sides]
    schema = T.StructType([T.StructField("id", id_type), *longs, *kinds])
    matched = store(usable.mapInArrow(run, schema).join(repeated.drop("copies"), ["h1", "h2"]))
    pairs = _with_sources(matched, repeated)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sided = (batch.column(c).to_pylist() for c in ("left", "source_left", "whole", "right", "source_right", "inside"))
            out = [
                [*reach_left(left, source_left, whole), *reach_right(right, source_right, inside)]
                for left, source_left, whole, right, source_right, inside in zip(*sided, strict=True)
            ]
            more = np.array(out, np.int64).reshape(-1, 4).T
            points, end_points, words, end_words = (batch.column(c).to_numpy().astype(np.int64) for c in NUMBERS[1:])
            found = (points - more[0], end_points + more[2], words - more[1], end_words + more[3])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("row"), batch.column("first_id"), *(pa.array(x) for x in found)],
                ["id", "row", "first_id", "start", "end", "before", "up_to"],
            )

    longs = [T.StructField(c, T.LongType()) for c in ("start", "end", "before", "up_to")]
    schema = T.StructType([T.StructField("id", id_type), T.StructField("row", T.LongType()), T.StructField("first_id", id_type), *longs])
    stretches = pairs.mapInArrow(extend, schema)
    # A source's stretches are joined first, so that no word counts twice for it.
    shares = _joined(stretches, ["id", "row", "first_id"]).groupBy("id", "row", "first_id", "run").agg(*_hull())
    piece = F.struct("first_id", "before", "up_to")
    runs = _joined(shares.drop("run"), ["id", "row"]).groupBy("id", "row", "run").agg(*_hull(), F.collect_list(piece).alias("pieces"))
    n_words = F.col("up_to") - F.col("before")
    runs = runs.where(n_words >= s.least_words).select("id", "start", "end", n_words.alias("n_words"), "before", F.sort_array("pieces").alias("pieces"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("pieces", "before", "n_words"))
            named = [named_sources(*row, s.least_words) for row in zip(*columns, strict=True)]
            kept = [batch.column(c) for c in ("id", "start", "end", "n_words")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(named, pa.list_(arrow_id))], [doc_id, "start", "end", "n_words", "source_ids"])

    longs = [T.StructField(c, T.LongType()) for c in ("start", "end", "n_words")]
    return runs.mapInArrow(name, T.StructType([T.StructField(doc_id, id_type), *longs, T.StructField("source_ids", T.ArrayType(id_type))]))


def named_sources(pieces: list[dict], first: int, n_words: int, least: int) -> list:
    """Of sorted pieces' documents those that account for `least` words, or for the most.

    A word is accounted for by the document of smallest id that has it.
    """
    taken, words = bytearray(n_words), {}
    for piece in pieces:
        a, b = piece["before"] - first, piece["up_to"] - first
        words[piece["first_id"]] = words.get(piece["first_id"], 0) + taken.count(0, a, b)
        taken[a:b] = b"\1" * (b - a)
    enough = min(max(words.values()), least)
    return [name for name, n in words.items() if n >= enough]


def _hull() -> list[F.Column]:
    return [F.min("start").alias("start"), F.max("end").alias("end"), F.min("before").alias("before"), F.max("up_to").alias("up_to")]


def _joined(stretches: DataFrame, keys: list[str]) -> DataFrame:
    """`stretches` with a number `run`, the same for those of a key that overlap or touch."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start") > reached, 1).otherwise(0)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return stretches.withColumn("new", new).withColumn("run", F.sum("new").over(so_far)).drop("new")
