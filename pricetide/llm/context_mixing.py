"""LM scoring: word unigrams, and logistic mixing of hashed-context bit predictors.

The training texts' counts are gathered in one pass. Word counts are not put into one table:
each task sends the words of its texts, with the texts they occur in, to shards by hash; a
shard adds up a word's count over the corpus and returns each text's share of the sum. Bit
counts of byte contexts go into hashed tables of a fixed size, which each task sums for its
texts and which are then added up part by part. The tables are kept for two sides of the
corpus, told apart by a hash of the text, and for both together.

Mixing weights and the refinement of the mixed probability are learnt online, in steps over
parts of the training texts that double in size. A step predicts the texts of its part, each by
the counts of the other side, so no text or copy of it predicts itself; then it moves towards
their bits. Every training text is learnt from once. Parts and sides follow from the texts, and
a step's sums don't depend on their order, so the dealing of rows to tasks changes nothing. A
last pass scores all texts by the counts of both sides.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pricetide.llm.common import FOLD, IS_SPACE, mix, sigmoid, slices, small_batches, store, utf8, word_hashes, word_places

#: A byte that UTF-8 never has: it ends each text.
END = 0xFF
PARTS = 64
#: Bytes of text, and of these distinct grams, that are worked on at a time: they bound memory.
TEXT_BYTES = 4_000_000
GRAM_BLOCK = 1 << 16
LOT = 1_500_000
#: Bytes of texts whose scores wait to be worked out together, at four bytes of memory each.
HELD_GRAMS = 16_000_000
#: Added to both counts of a slot.
DELTA = 0.05
#: Gates tell apart counts of 1, 2 to 3, and more of the highest order that has seen the context.
LEVELS = 3
#: Entries of a gate's refinement.
STEPS = 33
#: Predictions are kept as whole numbers, in so many parts of 1, up to 15 either way.
STRETCH_PARTS, MOST = 2048, 15.0
#: Sums of a task are sent in so many parts of 1; what is learnt is kept in so many.
SUM_PARTS, VALUE_PARTS = 1 << 20, 1 << 14


@dataclass(frozen=True)
class Settings:
    """table_bits: size of the hashed table of each order (of 1, 2, ... bytes of context);
    doublings: steps of learning, beyond the first, over parts of the training texts that double;
    shard_bytes: bytes of text whose words one shard gets."""

    table_bits: tuple[int, ...] = (16, 20, 21, 22, 22)
    doublings: int = 4
    shard_bytes: int = 16_000_000

    @property
    def orders(self) -> int:
        return len(self.table_bits)

    @property
    def starts(self) -> list[int]:
        """Where each order's table begins in the one row of all tables."""
        return np.concatenate([[0], np.cumsum([1 << b for b in self.table_bits])]).tolist()


def byte_grams(data: np.ndarray, offsets: np.ndarray, orders: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text and its end, the byte with `orders` bytes before it, as a number.

    Bytes before a text are zeros. Also len + 1 offsets of the texts in the result.
    """
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    # Seven bytes in front, so that a number of eight bytes ends at each place.
    padded = np.zeros(7 + len(data) + n * (orders + 1), np.uint8)
    buffer = padded[7:]
    ends = offsets[1:] + np.arange(1, n + 1) * orders + np.arange(n)
    inside = np.ones(len(buffer), bool)
    first = ends - lengths
    for back in range(1, orders + 1):
        inside[first - back] = False
    inside[ends] = False
    buffer[inside] = data
    buffer[ends], inside[ends] = END, True
    grams = np.ndarray(len(buffer), ">u8", padded, strides=(1,)).astype(np.uint64)[inside]
    grams &= np.uint64((1 << (8 * (orders + 1))) - 1)
    return grams, np.concatenate([[0], np.cumsum(lengths + 1)])


_BITS = np.arange(8)
_BYTE = np.arange(256)[:, None]
_BIT_ROWS = ((_BYTE >> (7 - _BITS)) & 1).astype(np.int8)
#: For each byte, the eight places in the binary tree of its context where a bit is predicted.
_NODE_ROWS = ((1 << _BITS) | (_BYTE >> (8 - _BITS))).astype(np.uint32)


def bits_of(grams: np.ndarray) -> np.ndarray:
    """The bits of each gram's last byte, the highest first."""
    return _BIT_ROWS[(grams & np.uint64(0xFF)).astype(np.uint8)]


def slots(grams: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Table slots of the 8 bit predictions of each gram of `order` + 1 bytes."""
    byte = (grams & np.uint64(0xFF)).astype(np.uint8)
    context = grams >> np.uint64(8)
    if order == 1:
        return (context.astype(np.uint32) << np.uint32(8))[:, None] | _NODE_ROWS[byte]
    # An odd factor keeps the places of one context apart.
    spread = (_NODE_ROWS * np.uint32(0x9E3779B1)) & np.uint32((1 << bits) - 1)
    first = (mix(context + np.uint64(order << 56)) >> np.uint64(64 - bits)).astype(np.uint32)
    return first[:, None] ^ spread[byte]


def places_of(grams: np.ndarray, order: int, s: Settings) -> np.ndarray:
    """The slots of `grams` in the one row of all tables, as numpy's own index type."""
    at = slots(grams, order, s.table_bits[order - 1]).astype(np.intp)
    at += s.starts[order - 1]
    return at


def distinct_grams(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams, those with the same last bytes together, and how often each occurs."""
    turned = np.sort(grams.byteswap())
    first = np.flatnonzero(np.concatenate([[True], turned[1:] != turned[:-1]])[: len(turned)])
    return turned[first].byteswap(), np.diff(np.append(first, len(turned)))


def by_order(grams: np.ndarray, orders: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each order from the highest: its distinct grams, and which of them each given gram has.

    Grams with the same last bytes have to be together.
    """
    for order in range(orders, 0, -1):
        shorter = grams & np.uint64((1 << (8 * (order + 1))) - 1)
        new = np.concatenate([[True], shorter[1:] != shorter[:-1]])
        yield order, shorter[new], np.cumsum(new) - 1


def blocks(n: int) -> Iterator[slice]:
    for first in range(0, n, GRAM_BLOCK):
        yield slice(first, first + GRAM_BLOCK)


def add_counts(tables: np.ndarray, grams: np.ndarray, counts: np.ndarray, side: int, s: Settings) -> None:
    """Add the bits of distinct grams to the counts (slot, side, bit) of all orders."""
    flat = tables.reshape(-1)
    for block in blocks(len(grams)):
        for order, distinct, codes in by_order(grams[block], s.orders):
            weight = np.bincount(codes, counts[block], len(distinct)).astype(tables.dtype)
            at = places_of(distinct, order, s)
            at *= 4
            at += 2 * side + bits_of(distinct)
            # Flat places and weights of the tables' own type: numpy adds these several times as fast.
            np.add.at(flat, at.ravel(), np.repeat(weight, 8))


@dataclass
class Table:
    """What each slot predicts, in STRETCH_PARTS, and its counts' level: 0 if it was never seen."""

    stretched: np.ndarray  # int16
    level: np.ndarray  # uint8
    _both: np.ndarray | None = field(default=None, compare=False)

    def __getstate__(self) -> list[bytes]:
        # Slots that nothing has met, and the few kinds of the others, take little room when packed.
        return [zstandard.compress(x.tobytes(), 1) for x in (self.stretched, self.level)]

    def __setstate__(self, packed: list[bytes]) -> None:
        kinds = (np.int16, np.uint8)
        self.stretched, self.level = (np.frombuffer(zstandard.decompress(x), k) for x, k in zip(packed, kinds, strict=True))
        self._both = None

    def at(self, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Predictions and levels of slots; both lie in one number, so a slot is looked up once."""
        if self._both is None:
            self._both = (self.stretched.astype(np.int32) << 2) | self.level
        found = self._both.take(where)
        return found >> 2, (found & 3).astype(np.uint8)

    @staticmethod
    def of(zeros: np.ndarray, ones: np.ndarray) -> Table:
        value = np.clip(np.log((ones + DELTA) / (zeros + DELTA)), -MOST, MOST)
        n = zeros + ones
        level = (n > 0).astype(np.uint8) + (n > 1) + (n > 3)
        return Table(np.rint(value * STRETCH_PARTS).astype(np.int16), level)


@dataclass
class Sums:
    """Sums over predicted bits, by gate: slopes, curvature, and weight and ones by refinement entry."""

    slope: np.ndarray
    curve: np.ndarray
    cells: np.ndarray
    ones: np.ndarray

    @staticmethod
    def nought(s: Settings) -> Sums:
        gates = 8 * (s.orders * LEVELS + 1)
        shapes = ((gates, s.orders), (gates, s.orders, s.orders), (gates, STEPS), (gates, STEPS))
        return Sums(*(np.zeros(x) for x in shapes))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.slope, self.curve, self.cells, self.ones)])

    def fill(self, flat: np.ndarray) -> Sums:
        at = 0
        for x in (self.slope, self.curve, self.cells, self.ones):
            x.reshape(-1)[:] = flat[at : at + x.size]
            at += x.size
        return self


@dataclass
class Mixer:
    """Gated weights, the refinement of what they give, and the curvature seen so far."""

    settings: Settings
    weights: np.ndarray = field(init=False)
    refined: np.ndarray = field(init=False)
    curve: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        s = self.settings
        gates = 8 * (s.orders * LEVELS + 1)
        self.weights = np.full((gates, s.orders), 0.4)
        self.refined = np.tile(sigmoid(np.linspace(-8, 8, STEPS)), (gates, 1))
        self.curve = np.tile(20 * np.eye(s.orders), (gates, 1, 1))

    def inputs(self, grams: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray]:
        """Stretched predictions (order, gram, bit), and the gate of each (gram, bit).

        The gate is the bit's place, the highest order that has seen its context, and how often
        it has.
        """
        s = self.settings
        out = np.empty((s.orders, len(grams), 8), np.float32)
        known = np.zeros((len(grams), 8), np.uint8)
        # A level of nought stays, others come after those of all lower orders.
        known_level = np.array([[0, *range(1 + at * LEVELS, 1 + (at + 1) * LEVELS)] for at in range(s.orders)], np.uint8)
        for order, distinct, codes in by_order(grams, s.orders):
            value, level = table.at(places_of(distinct, order, s))
            value = value.astype(np.float32)
            value *= np.float32(1 / STRETCH_PARTS)
            level = known_level[order - 1].take(level)
            if len(distinct) < len(grams):
                value.take(codes, 0, out[order - 1], "clip")
                level = level.take(codes, 0)
            else:
                out[order - 1] = value
            np.maximum(known, level, out=known)
        return out, known.astype(np.intp) * 8 + np.arange(8)

    def mixed(self, inputs: np.ndarray, gates: np.ndarray) -> np.ndarray:
        total = np.zeros(gates.shape, np.float32)
        for order in range(self.settings.orders):
            total += self.weights[:, order].astype(np.float32).take(gates) * inputs[order]
        return np.clip(total, np.float32(-7.9), np.float32(7.9))

    def refine(self, mixed: np.ndarray, gates: np.ndarray) -> np.ndarray:
        """The final probability of a one: half the mixed one, half its refinement."""
        low, part = places(mixed)
        cell = gates * STEPS + low
        flat = self.refined.astype(np.float32).ravel()
        mapped = flat.take(cell) * (1 - part)
        cell += 1
        mapped += flat.take(cell) * part
        return np.clip((squashed(mixed) + mapped) * np.float32(0.5), np.float32(1 / 4096), np.float32(1 - 1 / 4096))

    def log10(self, grams: np.ndarray, table: Table) -> np.ndarray:
        """log10 of the probability of each distinct gram's last byte after the bytes before it."""
        out = np.zeros(len(grams))
        for block in blocks(len(grams)):
            inputs, gates = self.inputs(grams[block], table)
            final = self.refine(self.mixed(inputs, gates), gates).astype(np.float64)
            right = np.where(bits_of(grams[block]) == 1, final, 1 - final)
            product = right[:, 0].copy()
            for bit in range(1, 8):
                product *= right[:, bit]
            out[block] = np.log10(product)
        return out

    def gather(self, sums: Sums, grams: np.ndarray, counts: np.ndarray, table: Table) -> None:
        """Predict distinct grams and add to `sums` what there is to learn from their bits."""
        s = self.settings
        for block in blocks(len(grams)):
            inputs, gates = self.inputs(grams[block], table)
            mixed = self.mixed(inputs, gates)
            # Two bytes are sorted by their digits.
            by = np.argsort(gates.ravel().astype(np.int16), kind="stable")
            gate = gates.ravel().take(by)
            weight = counts[block].astype(float).take(by >> 3)
            bit = bits_of(grams[block]).ravel().take(by)
            value = mixed.ravel().take(by)
            p = squashed(value).astype(float)
            # Where the prediction is sure and wrong p * (1 - p) is next to nothing, and a step too wide.
            miss, bend = weight * (bit - p), weight * np.maximum(p * (1 - p), (bit - p) ** 2)
            x = inputs.reshape(s.orders, -1).take(by, 1).astype(float)
            bounds = np.append(np.flatnonzero(np.diff(gate, prepend=-1)), len(gate)).tolist()
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                own = x[:, a:b]
                sums.slope[gate[a]] += own @ miss[a:b]
                sums.curve[gate[a]] += (own * bend[a:b]) @ own.T
            low, part = places(value)
            cell = gate * STEPS + low
            for at, share in ((cell, 1 - part), (cell + 1, part)):
                heft = weight * share
                sums.cells += np.bincount(at, heft, sums.cells.size).reshape(sums.cells.shape)
                sums.ones += np.bincount(at, heft * bit, sums.ones.size).reshape(sums.ones.shape)

    def step(self, sums: Sums) -> None:
        """One online step: Newton's, by the curvature of all that has been seen."""
        self.curve += sums.curve
        move = np.linalg.solve(self.curve, sums.slope[:, :, None])[:, :, 0]
        self.weights = np.rint((self.weights + np.clip(move, -1, 1)) * VALUE_PARTS) / VALUE_PARTS
        target = np.divide(sums.ones, sums.cells, out=self.refined.copy(), where=sums.cells > 0)
        self.refined = self.refined + (target - self.refined) * (sums.cells / (sums.cells + 200))
        self.refined = np.rint(self.refined * VALUE_PARTS) / VALUE_PARTS


def squashed(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def places(mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry of the refinement below each value, and the way from there to the next one."""
    place = (mixed + 8) * 2
    low = place.astype(np.int32)
    return low, place - low


_PACKED = "shard long, kind int, unit long, ids {ids}, a binary, b binary, c binary, d binary"


def _gather(docs: DataFrame, doc_id: str, text: str, shards: int, s: Settings) -> DataFrame:
    """What tasks send on: words by shard (kind 1), table parts (kind 2), texts' own rows (kind 0)."""
    id_type = docs.schema[doc_id].dataType
    names = ["shard", "kind", "unit", "ids", "a", "b", "c", "d"]
    schema = _PACKED.format(ids=f"array<{id_type.simpleString()}>")
    arrow = pa.schema(
        [("shard", pa.int64()), ("kind", pa.int32()), ("unit", pa.int64()), ("ids", pa.list_(to_arrow_type(id_type)))]
        + [(c, pa.binary()) for c in "abcd"]
    )

    def rows(items: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in items], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, lots = np.zeros((s.starts[-1], 2, 2), np.int32), Lots(s.orders)
        unit = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, text, TEXT_BYTES):
                unit += 1
                trained = ~np.array(part.column("held").to_pylist(), bool)
                data, offsets = utf8(part.column(text))
                starts, ends, words = word_places(~IS_SPACE[data], offsets)
                yield rows(_unit_rows(unit, part.column(doc_id).to_pylist(), data, starts, ends, words, trained, shards, offsets))
                for side, grams, counts in lots.add(part.filter(pa.array(trained)), text):
                    add_counts(tables, grams, counts, side, s)
        for side, grams, counts in lots.rest():
            add_counts(tables, grams, counts, side, s)
        for number, piece in enumerate(np.array_split(tables, PARTS)):
            if piece.any():
                # Low bytes for all slots, the rest for the few that have more: this packs well.
                flat = piece.reshape(-1)
                more = np.flatnonzero(flat > 255).astype(np.int32)
                parts = ((flat & 255).astype(np.uint8), more, flat[more] >> 8)
                yield rows([(-1 - number, 2, number, None, *(x.tobytes() for x in parts), None)])

    return docs.select(doc_id, text, "held", "side").mapInArrow(run, schema)


class Lots:
    """Distinct grams of many texts, handed on side by side when there are LOT of them."""

    def __init__(self, orders: int) -> None:
        self.orders = orders
        self.held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]

    def add(self, batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Take the texts of a batch; what there is too much of comes back as (side, grams, counts)."""
        of = batch.column("side").to_numpy(zero_copy_only=False)
        for side, held in enumerate(self.held):
            if (of == side).any():
                texts = utf8(batch.column(text).filter(pa.array(of == side)))
                held.append(distinct_grams(byte_grams(*texts, self.orders)[0]))
        yield from self.rest(LOT)

    def rest(self, least: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for side, held in enumerate(self.held):
            if sum(len(grams) for grams, _ in held) >= least:
                grams, counts = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                by = np.argsort(grams.byteswap())
                grams, counts = grams[by], counts[by]
                first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
                grams, counts = grams[first], np.add.reduceat(counts, first)
                # Merged they may be few enough to wait for more texts.
                if 4 * len(grams) >= 3 * least:
                    yield side, grams, counts
                else:
                    held.append((grams, counts))


def text_digest(text: bytes) -> bytes:
    """16 bytes that tell texts apart."""
    return xxhash.xxh3_128_digest(text)


def _unit_rows(unit: int, ids: list, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, trained: np.ndarray, shards: int, offsets: np.ndarray) -> list[tuple]:
    """The unit's own row, and a row for each shard that gets some of its words."""
    body = data.tobytes()
    digests = b"".join(text_digest(body[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
    out = [(1_000_000_007 + unit, 0, unit, ids, digests, np.diff(words).tobytes(), trained.tobytes(), None)]
    if not len(starts):
        return out
    hashes = word_hashes(FOLD[data], starts, ends)
    text_of = np.repeat(np.arange(len(words) - 1), np.diff(words)).astype(np.int32)
    by = np.argsort(hashes, kind="stable")
    hashes, text_of = hashes[by], text_of[by]
    new_word = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    new_pair = new_word | np.concatenate([[True], text_of[1:] != text_of[:-1]])
    pair = np.flatnonzero(new_pair)
    times = np.diff(np.concatenate([pair, [len(hashes)]])).astype(np.int32)
    first = np.flatnonzero(new_word[pair])  # the first pair of each word
    word = hashes[pair][first]
    texts = np.diff(np.concatenate([first, [len(pair)]])).astype(np.int32)
    shard = ((word >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    edges = np.concatenate([np.flatnonzero(np.diff(shard, prepend=-1)), [len(word)]])
    bounds = np.concatenate([first, [len(pair)]])
    owner = text_of[pair]
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        pairs = slice(bounds[a], bounds[b])
        out.append(
            (int(shard[a]), 1, unit, None, word[a:b].tobytes(), texts[a:b].tobytes(), owner[pairs].tobytes(), times[pairs].tobytes() + trained.tobytes())
        )
    return out


def _combine(packed: DataFrame, shards: int, s: Settings) -> DataFrame:
    """Shards' sums of each unit's texts (kind 1), their distinct words (3), summed parts (2).

    Every kind of row reaches the partition of its shard; parts are summed as they come.
    """
    arrow_ids = to_arrow_type(packed.schema["ids"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        held: dict[int, list[dict]] = defaultdict(list)
        arrow = pa.schema(
            [("kind", pa.int32()), ("unit", pa.int64()), ("ids", arrow_ids)] + [(c, pa.binary()) for c in "abc"]
        )

        def rows(items: list[tuple]) -> pa.RecordBatch:
            names = ["kind", "unit", "ids", "a", "b", "c"]
            return pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in items], schema=arrow)

        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    yield rows([(0, row["unit"], row["ids"], row["a"], row["b"], row["c"])])
                elif row["kind"] == 2:
                    counts = np.frombuffer(row["a"], np.uint8).astype(np.int64)
                    counts[np.frombuffer(row["b"], np.int32)] += np.frombuffer(row["c"], np.int32).astype(np.int64) << 8
                    sums[row["unit"]] = sums.get(row["unit"], 0) + counts
                else:
                    held[row["shard"]].append(row)
        for number, counts in sums.items():
            pairs = counts.reshape(-1, 2, 2)
            for which, two in enumerate((pairs[:, 0], pairs[:, 1], pairs.sum(1))):
                made = Table.of(two[:, 0], two[:, 1])
                yield rows([(2, which * PARTS + number, None, made.stretched.tobytes(), made.level.tobytes(), None)])
        for _, members in held.items():
            yield rows(_shard_rows(members))

    out = f"kind int, unit long, ids {packed.schema['ids'].dataType.simpleString()}, a binary, b binary, c binary"
    return packed.repartition(shards, "shard").mapInArrow(run, out)


def _shard_rows(members: list[dict]) -> list[tuple]:
    """A shard's words counted over all units, and what each unit's texts get of the sum."""
    words = np.concatenate([np.frombuffer(m["a"], np.uint64) for m in members])
    unpacked = []
    for m in members:
        texts = np.frombuffer(m["b"], np.int32)
        owner = np.frombuffer(m["c"], np.int32)
        times = np.frombuffer(m["d"], np.int32, len(owner))
        trained = np.frombuffer(m["d"], bool, offset=4 * len(owner))
        word = np.repeat(np.arange(len(texts)), texts)
        unpacked.append((word, owner, times, trained, len(texts)))
    codes, distinct = pd.factorize(words)
    counts = np.zeros(len(distinct), np.int64)
    at = 0
    for word, owner, times, trained, n in unpacked:
        counts += np.bincount(codes[at : at + n][word], times * trained[owner], len(distinct)).astype(np.int64)
        at += n
    value = np.log10(counts + 0.5)
    out, at = [], 0
    for m, (word, owner, times, trained, n) in zip(members, unpacked, strict=True):
        mine = codes[at : at + n][word]
        at += n
        texts = np.unique(owner)
        place = np.searchsorted(texts, owner)
        sums = np.bincount(place, times * value[mine], len(texts))
        known = np.bincount(place, times * (counts[mine] > 0), len(texts)).astype(np.int32)
        out.append((1, m["unit"], None, texts.astype(np.int32).tobytes(), sums.tobytes(), known.tobytes()))
    out.append((3, int((counts > 0).sum()), None, None, None, None))
    return out


def _per_text(combined: DataFrame, id_type: T.DataType) -> DataFrame:
    """A row (id, digest, words, part_sum, known) for each text: its unit's rows added up."""
    arrow_id = to_arrow_type(id_type)

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next(r for r in rows if r["kind"] == 0)
        n = len(own["ids"])
        sums, known = np.zeros(n), np.zeros(n, np.int64)
        # The order of adding is fixed, so that a text's sum is the same in every run.
        for r in sorted((r for r in rows if r["kind"] == 1), key=lambda r: (r["a"], r["b"])):
            texts = np.frombuffer(r["a"], np.int32)
            sums[texts] += np.frombuffer(r["b"], np.float64)
            known[texts] += np.frombuffer(r["c"], np.int32)
        digests = [own["a"][16 * i : 16 * i + 16] for i in range(n)]
        return pa.table(
            [pa.array(own["ids"], arrow_id), pa.array(digests, pa.binary()), pa.array(np.frombuffer(own["b"], np.int64)), pa.array(sums), pa.array(known)],
            names=["id", "digest", "words", "part_sum", "known"],
        )

    schema = T.StructType(
        [
            T.StructField("id", id_type),
            T.StructField("digest", T.BinaryType()),
            T.StructField("words", T.LongType()),
            T.StructField("part_sum", T.DoubleType()),
            T.StructField("known", T.LongType()),
        ]
    )
    return combined.where("kind IN (0, 1)").groupBy("unit").applyInArrow(run, schema)


def _tables(combined: DataFrame, s: Settings) -> list[Table]:
    """The tables of either side and of both, put together from their parts."""
    made = [Table(np.zeros(s.starts[-1], np.int16), np.zeros(s.starts[-1], np.uint8)) for _ in range(3)]
    edges = np.cumsum([0] + [len(x) for x in np.array_split(made[0].level, PARTS)])
    for row in combined.where("kind = 2").select("unit", "a", "b").toLocalIterator():
        which, number = divmod(row["unit"], PARTS)
        where = slice(edges[number], edges[number + 1])
        made[which].stretched[where] = np.frombuffer(row["a"], np.int16)
        made[which].level[where] = np.frombuffer(row["b"], np.uint8)
    return made


def _with_sides(docs: DataFrame, text: str, s: Settings) -> DataFrame:
    """Add `side` (0 or 1) and `part` (0 and up; each is learnt from in one step), by the text."""
    parts = 1 << s.doublings
    mixed = F.xxhash64(text)
    part = F.pmod(F.shiftright(mixed, 8), F.lit(parts))
    # Parts 1, 2 to 3, 4 to 7 and so on double in size; 0 is as large as 1.
    step = sum(((part >= (1 << k)).cast("int") for k in range(s.doublings)), F.lit(0))
    return docs.withColumns({"side": F.pmod(mixed, F.lit(2)).cast("int"), "part": step})


def _fit_mixer(mixer: Mixer, shared: Any, docs: DataFrame, text: str) -> None:
    """Learn from all rows that are not held out, in a step for each part.

    `shared` are the broadcast tables of both sides; a side's texts are predicted by the other's.
    """
    s = mixer.settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, lots = Sums.nought(s), Lots(s.orders)
        for batch in batches:
            for piece in slices(batch, text, TEXT_BYTES):
                for side, grams, counts in lots.add(piece, text):
                    mixer.gather(sums, grams, counts, shared.value[1 - side])
        for side, grams, counts in lots.rest():
            mixer.gather(sums, grams, counts, shared.value[1 - side])
        # Whole numbers, so that sums don't depend on the order of adding.
        values = np.rint(sums.flat() * SUM_PARTS)
        at = np.flatnonzero(values)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(values[at])], ["at", "value"])

    for part in range(s.doublings + 1):
        found = docs.where(~F.col("held") & (F.col("part") == part)).select(text, "side").mapInArrow(run, "at long, value double")
        added = found.groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
        flat = Sums.nought(s).flat()
        for row in added.collect():  # a row for each number of Sums at most
            flat[row["at"]] = float(row["value"]) / SUM_PARTS
        mixer.step(Sums.nought(s).fill(flat))


def score_texts(
    docs: DataFrame, held: Any, text: str = "text", doc_id: str = "doc_id", settings: Settings | None = None
) -> DataFrame:
    """A row for each row of `docs`: counts of its tokens, and log10 probabilities of its text.

    Rows where the column expression `held` is true are scored and not learnt from. Columns:
    `doc_id`, `held_out`, `n_tokens` (words, A-Z lower-cased, and one end), `n_known` (of those
    that the training texts have), `train_tokens`, `base_score` (add-one-half unigrams) and
    `score` (context mixing of the bytes of the text and its end), and `bits_per_byte`.

    Null and empty texts have the end only. Rows that repeat an id, and null ids, are rows of
    their own. Without any training text the counts are nought and every bit costs one. No column
    depends on the order of the rows or on how they are dealt to partitions. Words are counted by
    64-bit hashes. Other columns of `docs` play no part.
    """
    s = settings or Settings()
    spark = docs.sparkSession
    small_batches(spark)
    docs = _with_sides(docs.select(doc_id, text, held.alias("held")), text, s)
    size = docs.agg(F.sum(F.octet_length(text)).alias("bytes"), F.sum((~F.col("held")).cast("long")).alias("texts")).first()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size["bytes"] or 0) // s.shard_bytes))
    combined = store(_combine(_gather(docs, doc_id, text, shards, s), shards, s))

    *halves, whole = _tables(combined, s)
    mixer = Mixer(s)
    shared = spark.sparkContext.broadcast(halves)
    _fit_mixer(mixer, shared, docs, text)
    shared.destroy()
    shared = spark.sparkContext.broadcast(whole)

    texts = _per_text(combined, docs.schema[doc_id].dataType)
    base = store(texts)
    distinct = combined.where("kind = 3").agg(F.sum("unit")).first()[0] or 0
    trained = size["texts"] or 0
    flagged = _flagged_words(combined)
    tokens = flagged + trained
    kinds = distinct + (1 if trained else 0)

    id_type = docs.schema[doc_id].dataType
    schema = T.StructType(
        [
            T.StructField("id", id_type),
            T.StructField("held", T.BooleanType()),
            T.StructField("digest", T.BinaryType()),
            T.StructField("bytes", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The more texts are predicted together, the fewer distinct grams they have.
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, list[pa.Array]]] = []
        for batch in batches:
            for part in slices(batch, text, TEXT_BYTES):
                data, offsets = utf8(part.column(text))
                grams, places = byte_grams(data, offsets, s.orders)
                codes, found = pd.factorize(grams)
                del grams
                body = data.tobytes()
                digests = [text_digest(body[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                own = [part.column(doc_id), part.column("held"), pa.array(digests, pa.binary()), pa.array(np.diff(offsets))]
                held.append((found, codes.astype(np.int32), places, own))
                if sum(len(x[0]) for x in held) >= LOT or sum(len(x[1]) for x in held) >= HELD_GRAMS:
                    yield from scores(held)
                    held.clear()
        yield from scores(held)

    def scores(held: list) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        numbers, every = pd.factorize(np.concatenate([x[0] for x in held]))
        by = np.argsort(every.byteswap())
        values = np.empty(len(every))
        values[by] = mixer.log10(every[by], shared.value)
        at = 0
        for found, codes, places, own in held:
            mine = values[numbers[at : at + len(found)]]
            at += len(found)
            total = np.add.reduceat(mine.take(codes), places[:-1])
            yield pa.RecordBatch.from_arrays([*own, pa.array(total)], [f.name for f in schema.fields])

    scored = docs.select(doc_id, text, "held").mapInArrow(run, schema)
    base = base.dropDuplicates(["id", "digest"])
    joined = scored.alias("s").join(
        base.alias("b"), F.col("s.id").eqNullSafe(F.col("b.id")) & (F.col("s.digest") == F.col("b.digest"))
    )
    end_known = F.lit(1 if trained else 0)
    return joined.select(
        F.col("s.id").alias(doc_id),
        F.col("held").alias("held_out"),
        (F.col("words") + 1).alias("n_tokens"),
        (F.col("known") + end_known).cast("long").alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (
            F.col("part_sum") + F.lit(float(np.log10(trained + 0.5))) - (F.col("words") + 1) * F.lit(float(np.log10(tokens + 0.5 * (kinds + 1))))
        ).alias("base_score"),
        F.col("score"),
        (-F.col("score") * F.lit(float(np.log2(10))) / (F.col("bytes") + 1)).alias("bits_per_byte"),
    )


def _flagged_words(combined: DataFrame) -> int:
    """Words of the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            for words, trained in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total += int(np.frombuffer(words, np.int64)[np.frombuffer(trained, bool)].sum())
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], ["n"])

    return combined.where("kind = 0").select("b", "c").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
