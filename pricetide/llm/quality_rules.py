"""Quality rules: counted base rules, and a hashed n-gram logistic regression with a fixed threshold."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide.llm.common import (
    IS_SPACE,
    fit_platt,
    mix,
    per_text,
    sigmoid,
    slices,
    struct,
    utf8,
    window_hashes,
    with_result,
    word_hashes,
    word_places,
)

#: Symbols that are counted, and the base limits.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 20
REPEAT_WINDOW = 8
MOST_REPEATED_PERCENT = 30

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_LEAD = (np.arange(256) & 0xC0) != 0x80


@dataclass(frozen=True)
class Settings:
    """max_examples: labelled rows of each class that are fitted on (those of smallest hash);
    bits: hash bits of each of the two feature tables; gram: bytes of a character n-gram;
    steps and rate: of the gradient descent; threshold: least probability of a kept text."""

    max_examples: int = 1500
    bits: int = 18
    gram: int = 4
    steps: int = 60
    rate: float = 0.3
    threshold: float = 0.5


@dataclass
class Model:
    """Weights of hashed words and character n-grams, and the calibration."""

    settings: Settings
    word_weights: np.ndarray
    gram_weights: np.ndarray
    intercept: float
    slope: float
    shift: float


COLUMNS = {
    "n_words": T.LongType(),
    "word_chars": T.LongType(),
    "n_symbols": T.LongType(),
    "n_dup_lines": T.LongType(),
    "n_repeat_words": T.LongType(),
    "base_failed": T.BooleanType(),
    "probability": T.DoubleType(),
    "kept": T.BooleanType(),
}
RESULT = T.StructType([T.StructField(n, t) for n, t in COLUMNS.items()])


def repeated_words(hashes: np.ndarray, offsets: np.ndarray, width: int = REPEAT_WINDOW) -> np.ndarray:
    """Flags of words in a window of `width` words that its text has twice or more."""
    windows = window_hashes(hashes, width)
    flags = np.zeros(len(hashes) + 1, np.int64)
    if len(windows) == 0:
        return flags[:-1] > 0
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = np.flatnonzero(text_of[: len(windows)] == text_of[width - 1 :])
    # Windows of different texts are told apart by the text's number in the hash.
    keys = mix(windows[inside] ^ mix(text_of[inside].astype(np.uint64)))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    first = inside[twice]
    flags[first] += 1
    np.subtract.at(flags, first + width, 1)
    return np.cumsum(flags[:-1]) > 0


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    seen, found = set(), 0
    for line in lines:
        if line in seen:
            found += bool(line.split())
        seen.add(line)
    return found


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Hash bucket of each word and of the n-gram that begins at each byte (case kept)."""
    mask = np.uint64((1 << settings.bits) - 1)
    words = (word_hashes(data, starts, ends) & mask).astype(np.int32)
    padded = np.concatenate([data, np.zeros(settings.gram, np.uint8)]).astype(np.uint32)
    grams = np.zeros(len(data), np.uint32)
    for at in range(settings.gram):
        grams = (grams * np.uint32(0x01000193)) ^ padded[at : at + len(data)]
    grams *= np.uint32(0x9E3779B1)
    return words, (grams >> np.uint32(32 - settings.bits)).astype(np.int32)


def means(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The mean of `values` between consecutive offsets; 0 where there are none."""
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    counts = np.diff(offsets)
    return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(counts, 1)


def _examples(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str, bound: int) -> list[tuple[str, int, int]]:
    """Texts and labels of the chosen rows, with the size of their class among all labelled."""
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).select(
        F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__good")
    )
    # A row that is labelled twice is good only if every label says so.
    known = known.groupBy("__id").agg(F.min("__good").alias("__good"))
    known = known.join(docs.select(F.col(doc_id).alias("__id")), "__id", "left_semi")
    sizes = {r["__good"]: r["count"] for r in known.groupBy("__good").count().collect()}
    chosen = [
        (r["__id"], r["__good"])
        for value in (0, 1)
        for r in known.where(F.col("__good") == value).orderBy(F.xxhash64("__id"), "__id").limit(bound).collect()
    ]
    if not chosen:
        return []
    wanted = docs.sparkSession.createDataFrame(chosen, known.schema)
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(wanted), "__id")
    # A chosen id that several rows have stands for the least of their texts.
    found = rows.groupBy("__id", "__good").agg(F.min("__text").alias("__text")).collect()
    return [(r["__text"] or "", r["__good"], sizes[r["__good"]]) for r in sorted(found, key=lambda r: r["__id"])]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    settings: Settings | None = None,
    text: str = "text",
    doc_id: str = "doc_id",
    label: str = "quality",
) -> Model:
    """Fit on the rows of `docs` that `labels` covers, at most `max_examples` of each class.

    Every fourth example is kept for the calibration (Platt's, weighted by the classes' true
    sizes). With labels of one class or none the probability is that class's, or one half.
    """
    settings = settings or Settings()
    examples = _examples(docs, labels, text, doc_id, label, settings.max_examples)
    size = 1 << settings.bits
    model = Model(settings, np.zeros(size), np.zeros(size), 0.0, 1.0, 0.0)
    if not examples:
        return model
    good = np.array([e[1] for e in examples])
    share = np.array([e[2] / (good == e[1]).sum() for e in examples], float)
    spare = np.arange(len(examples)) % 4 == 3
    hashed = []
    for value, _, _ in examples:
        data, offsets = utf8(pa.array([value]))
        starts, ends, _ = word_places(~IS_SPACE[data], offsets)
        hashed.append([np.unique(x, return_counts=True) for x in features(data, starts, ends, settings)])
    learn = np.flatnonzero(~spare)
    balance = np.where(good[learn] == 1, 1 / max(1, (good[learn] == 1).sum()), 1 / max(1, (good[learn] == 0).sum())) / 2
    if 0 < good[learn].sum() < len(learn):
        _descend(model, [hashed[i] for i in learn], good[learn], balance)
    raw = np.array([_raw(model, h) for h in hashed])
    held = spare if 0 < good[spare].sum() < spare.sum() else np.ones(len(good), bool)
    model.slope, model.shift = fit_platt(raw[held], good[held], share[held] * held.sum() / share[held].sum())
    return model


def _raw(model: Model, hashed: list[tuple[np.ndarray, np.ndarray]]) -> float:
    total = model.intercept
    for weights, (buckets, counts) in zip((model.word_weights, model.gram_weights), hashed, strict=True):
        total += float(weights[buckets] @ counts) / max(1, counts.sum())
    return total


def _descend(model: Model, hashed: list, good: np.ndarray, weight: np.ndarray) -> None:
    """Full-batch gradient steps with per-weight scaling, on mean features."""
    size = 1 << model.settings.bits
    tables = []
    for at in (0, 1):
        buckets = np.concatenate([h[at][0] for h in hashed])
        row = np.repeat(np.arange(len(hashed)), [len(h[at][0]) for h in hashed])
        values = np.concatenate([h[at][1] / max(1, h[at][1].sum()) for h in hashed])
        tables.append((buckets, row, values, np.zeros(size)))
    weights = (model.word_weights, model.gram_weights)
    for _ in range(model.settings.steps):
        raw = model.intercept + sum(
            np.bincount(row, w[buckets] * values, len(hashed)) for w, (buckets, row, values, _) in zip(weights, tables, strict=True)
        )
        miss = weight * (sigmoid(raw) - good)
        model.intercept -= model.settings.rate * float(miss.sum())
        for w, (buckets, row, values, squares) in zip(weights, tables, strict=True):
            slope = np.bincount(buckets, miss[row] * values, size)
            squares += slope * slope
            w -= 10 * model.settings.rate * slope / (np.sqrt(squares) + 1e-6)


def judge(docs: DataFrame, model: Model, text: str = "text", result: str = "quality") -> DataFrame:
    """`docs` with a struct column of counts, the base verdict, a probability and `kept`.

    Words are runs of characters other than blanks, tabs, line ends, form feeds and vertical
    tabs. A text fails the base rules with fewer than 20 words, or more than 30 % of its words
    in 8-word windows that it has twice or more; one that doesn't is kept if its calibrated
    probability of good quality reaches the threshold. Null and empty texts have no words and
    fail. Windows are compared by 64-bit hashes. Other columns pass through, except that one
    called `result` is replaced.
    """

    def make():  # noqa: ANN202
        return lambda batch: (
            pa.concat_arrays([_judged(part.column(text), model) for part in slices(batch, text)])
            if batch.num_rows
            else pa.array([], pa.struct([(n, ARROW[type(t)]) for n, t in COLUMNS.items()]))
        )

    return with_result(docs, result, RESULT, make)


ARROW = {T.LongType: pa.int64(), T.BooleanType: pa.bool_(), T.DoubleType: pa.float64()}


def _judged(texts: pa.Array, model: Model) -> pa.StructArray:
    settings = model.settings
    data, offsets = utf8(texts)
    inside = ~IS_SPACE[data]
    starts, ends, words = word_places(inside, offsets)
    n_words = np.diff(words)
    repeated = per_text(repeated_words(word_hashes(data, starts, ends), words), words)
    word_buckets, gram_buckets = features(data, starts, ends, settings)
    raw = model.intercept + means(model.word_weights[word_buckets], words) + means(model.gram_weights[gram_buckets], offsets)
    probability = sigmoid(model.slope * raw + model.shift)
    failed = (n_words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED_PERCENT * n_words)
    body = data.tobytes()
    lines = [duplicate_lines(body[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return struct(
        {
            "n_words": n_words,
            "word_chars": per_text(inside & _IS_LEAD[data], offsets),
            "n_symbols": per_text(_IS_SYMBOL[data], offsets),
            "n_dup_lines": pa.array(lines, pa.int64()),
            "n_repeat_words": repeated,
            "base_failed": failed,
            "probability": probability,
            "kept": ~failed & (probability >= settings.threshold),
        }
    )
