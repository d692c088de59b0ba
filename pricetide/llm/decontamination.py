"""Benchmark decontamination: one Aho-Corasick automaton over the words of all test items."""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from typing import Any

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide.llm.common import LOWER, UPPER, with_result

#: Characters of item texts that one automaton holds; more items are scanned for block by block.
BLOCK_CHARS = 16_000_000

#: Bytes of words: digits, letters (lower-cased) and everything beyond ASCII; others separate.
NORMAL = bytearray(b" " * 128 + bytes(range(128, 256)))
for _from, _to in zip(b"0123456789" + UPPER + LOWER, b"0123456789" + LOWER + LOWER, strict=True):
    NORMAL[_from] = _to
NORMAL = bytes(NORMAL)
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField(
            "runs",
            T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])),
        ),
        T.StructField(
            "spans",
            T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])),
        ),
    ]
)


def words_of(text: str | None) -> list[bytes]:
    """The normalised words of a text."""
    return text.encode().translate(NORMAL).split() if text else []


class Matcher:
    """The automaton of some items: windows of word numbers, with the items they occur in."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        self.numbers: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            numbers = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            for at in range(max(1, len(numbers) - window + 1) if numbers else 0):
                found[tuple(numbers[at : at + window])].add(item)
        self.shortest = min(map(len, found), default=0)
        self.automaton = None
        if found:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for window_numbers, names in found.items():
                self.automaton.add_word(window_numbers, (len(window_numbers), names))
            self.automaton.make_automaton()

    def scan(self, words: list[bytes], runs: list[dict[str, int]], items: list[str]) -> tuple[np.ndarray, set[str]]:
        """Flags of hit words and the items, together with what earlier blocks found."""
        marks = np.zeros(len(words) + 1, np.int64)
        for run in runs:
            marks[run["first"]] += 1
            marks[run["last"] + 1] -= 1
        names = set(items)
        if self.automaton is not None and len(words) >= self.shortest:
            get = self.numbers.get
            for end, (length, at) in self.automaton.iter(tuple([get(w, 0) for w in words])):
                marks[end + 1 - length] += 1
                marks[end + 1] -= 1
                names |= at
        return np.cumsum(marks[:-1]) > 0, names


_matchers: dict[str, Matcher] = {}


def _matcher(key: str, items: list[tuple[str, str]], window: int) -> Matcher:
    """The matcher of this operator call, built once in each Python worker."""
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(items, window)
    return _matchers[key]


def _runs(hit: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"first": int(a), "last": int(b) - 1} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def mark_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    result: str = "contamination",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """`docs` with a struct column: words, hit words, items found, and hit spans.

    A window is `window` consecutive words of an item, or the whole item if it has fewer words
    (but any). A word of a document inside an occurrence of a window is hit. `runs` are hit
    words by number (from 0, both ends included), `spans` the same in code points of the
    original text (end exclusive). Items are given as sorted strings.

    Items are read to the driver in blocks of about `block_chars` characters, and each block's
    automaton scans the texts once; results of blocks are merged, so that no number of items
    is too many. A null text has no words; a null, empty or wordless item and an item without
    id match nothing; items that repeat an id count as one, equal windows of several items
    count for each. Empty tables give empty results or none hit. Other columns of `docs` pass
    through, except that one called `result` is replaced.
    """
    items = benchmark.select(
        F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")
    ).where("item IS NOT NULL AND text IS NOT NULL")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    out = docs
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        rows = [(r["item"], r["text"]) for r in part.collect()]
        out = _scan_block(out, rows, window, text, result, first=block == 0, last=block == blocks - 1)
    return out


def _scan_block(
    docs: DataFrame, items: list[tuple[str, str]], window: int, text: str, result: str, first: bool, last: bool
) -> DataFrame:
    key = uuid.uuid4().hex
    if first:
        docs = docs.drop(result)
    held = "__earlier"
    if not first:
        docs = docs.withColumnRenamed(result, held)

    def make():  # noqa: ANN202
        matcher = _matcher(key, items, window)

        def compute(batch: pa.RecordBatch) -> pa.Array:
            earlier = [None] * batch.num_rows if first else batch.column(held).to_pylist()
            out: list[dict[str, Any]] = []
            for value, before in zip(batch.column(text), earlier, strict=True):
                body = value.as_py()
                words = words_of(body)
                before = before or {"runs": [], "items": []}
                hit, names = matcher.scan(words, before["runs"], before["items"])
                runs = _runs(hit) if names else []
                spans = []
                if runs and last:
                    places = [m.span() for m in WORD.finditer(body)]
                    spans = [{"start": places[r["first"]][0], "end": places[r["last"]][1]} for r in runs]
                out.append(
                    {
                        "n_words": len(words),
                        "n_hit": int(hit.sum()) if runs else 0,
                        "items": sorted(names),
                        "runs": runs,
                        "spans": spans,
                    }
                )
            return pa.array(out, ARROW_RESULT)

        return compute

    return with_result(docs, result, RESULT, make).drop(held)


_PAIR = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
ARROW_RESULT = pa.struct(
    [("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("runs", _PAIR), ("spans", _SPAN)]
)


def is_contaminated(result: str = "contamination") -> F.Column:
    """The contamination rule: any hit word, and at least a twentieth of all words hit."""
    n_hit, n_words = F.col(f"{result}.n_hit"), F.col(f"{result}.n_words")
    return (n_hit > 0) & (20 * n_hit >= n_words)
