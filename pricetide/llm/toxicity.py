"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pricetide.llm.common import fit_platt, sigmoid, small_batches, with_result
from pricetide.llm.decontamination import NORMAL

#: Distinct words whose terms a task remembers before it starts anew.
MEMORY_WORDS = 200_000


@dataclass(frozen=True)
class Settings:
    """Bounds and choices of the classifier; nothing else depends on the number of rows.

    max_examples: labelled rows of each class that are fitted on (those of smallest hash);
    max_terms: terms kept, by chi-square against the label; min_chi: least chi-square of a term;
    lift: least ratio between a term's shares of the two classes;
    prefixes: lengths of word beginnings that are terms besides the words;
    neighbours: nearest examples that vote; block: examples in a block of the index.
    """

    max_examples: int = 4000
    max_terms: int = 4096
    min_chi: float = 20.0
    lift: float = 3.0
    prefixes: tuple[int, ...] = (4, 5)
    neighbours: int = 15
    block: int = 64


RESULT = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField(
            "evidence",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("example", T.StringType()),
                        T.StructField("similarity", T.DoubleType()),
                        T.StructField("toxic", T.IntegerType()),
                    ]
                )
            ),
        ),
    ]
)
ARROW_RESULT = pa.struct(
    [
        ("score", pa.float64()),
        ("evidence", pa.list_(pa.struct([("example", pa.string()), ("similarity", pa.float64()), ("toxic", pa.int32())]))),
    ]
)


class Terms(dict):
    """From a word to the numbers of its terms, worked out once for each word."""

    def __init__(self, numbers: dict[bytes, int], prefixes: tuple[int, ...]) -> None:
        super().__init__()
        self.numbers, self.prefixes = numbers, prefixes

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > MEMORY_WORDS:
            self.clear()
        found = tuple(self.numbers[t] for t in word_terms(word, self.prefixes) if t in self.numbers)
        self[word] = found
        return found

    def count(self, text: str | None) -> Counter[int]:
        """How often each known term occurs in a text."""
        counts: Counter[int] = Counter()
        if text:
            for found in [f for w in text.encode().translate(NORMAL).split() if (f := self[w])]:
                counts.update(found)
        return counts


def word_terms(word: bytes, prefixes: tuple[int, ...]) -> Iterator[bytes]:
    """The word, and its beginnings marked by a star."""
    yield word
    for length in prefixes:
        if len(word) >= length:
            yield word[:length] + b"*"


def text_terms(text: str | None, prefixes: tuple[int, ...]) -> set[bytes]:
    """The distinct terms of a text."""
    words = set((text or "").encode().translate(NORMAL).split())
    return {t for w in words for t in word_terms(w, prefixes)}


class BlockMaxIndex:
    """Postings of the examples' unit vectors by term, and each block's largest weight."""

    def __init__(self, vectors: list[dict[int, float]], n_terms: int, block: int) -> None:
        self.block, self.size = block, len(vectors)
        entries = sorted((t, row, w) for row, vector in enumerate(vectors) for t, w in vector.items())
        self.rows = np.array([e[1] for e in entries], np.int64)
        self.weights = np.array([e[2] for e in entries])
        terms = np.array([e[0] for e in entries], np.int64)
        self.first = np.searchsorted(terms, np.arange(n_terms + 1))
        # Blocks of a term that hold it, with the largest weight and the place of their postings.
        keys = terms * (self.size // block + 1) + self.rows // block
        self.at = np.concatenate([np.flatnonzero(np.diff(keys, prepend=-1)), [len(keys)]]).astype(np.int64)
        self.block_of = (self.rows // block)[self.at[:-1]] if len(keys) else self.rows
        self.block_max = np.maximum.reduceat(self.weights, self.at[:-1]) if len(keys) else self.weights
        self.term_blocks = np.searchsorted(self.at[:-1], self.first)

    def nearest(self, vector: dict[int, float], k: int, but: int = -1) -> list[tuple[float, int]]:
        """The k most similar examples above zero, ties to the smaller row; `but` is left out.

        Blocks are taken by falling upper bound, until no bound reaches the k-th similarity.
        """
        bounds = np.zeros(self.size // self.block + 1)
        for term, weight in vector.items():
            a, b = self.term_blocks[term], self.term_blocks[term + 1]
            bounds[self.block_of[a:b]] += weight * self.block_max[a:b]
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        best: list[tuple[float, int]] = []
        done, step = 0, 2
        while done < len(order) and (len(best) < k or bounds[order[done]] >= best[-1][0] - 1e-12):
            # The next few blocks that may still hold a nearer example, twice as many each time.
            blocks = order[done : done + step]
            if len(best) == k:
                blocks = blocks[bounds[blocks] >= best[-1][0] - 1e-12]
            done, step = done + step, 2 * step
            best += [x for x in self._scored(vector, blocks) if x[1] != but]
            best.sort(key=lambda x: (-x[0], x[1]))
            del best[k:]
        return best

    def _scored(self, vector: dict[int, float], blocks: np.ndarray) -> list[tuple[float, int]]:
        """Similarities above zero of the examples in some blocks."""
        place = np.full(self.size // self.block + 1, -1)
        place[blocks] = np.arange(len(blocks))
        scores = np.zeros(len(blocks) * self.block)
        for term, weight in vector.items():
            rows = self.rows[self.first[term] : self.first[term + 1]]
            at = place[rows // self.block]
            inside = at >= 0
            scores[at[inside] * self.block + rows[inside] % self.block] += (
                weight * self.weights[self.first[term] : self.first[term + 1]][inside]
            )
        found = np.flatnonzero(scores)
        return [(float(scores[i]), int(blocks[i // self.block] * self.block + i % self.block)) for i in found]


@dataclass
class Model:
    """Everything that scores a text."""

    settings: Settings
    numbers: dict[bytes, int]
    idf: np.ndarray
    index: BlockMaxIndex
    names: list[str]
    toxic: np.ndarray
    slope: float = 0.0
    intercept: float = 0.0

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Similarity-weighted share of toxic neighbours; missing neighbours count as clean."""
        voted = sum(s for s, row in near if self.toxic[row])
        return voted / (sum(s for s, _ in near) + 0.05)

    def score(self, vector: dict[int, float]) -> tuple[float, list[tuple[float, int]]]:
        near = self.index.nearest(vector, self.settings.neighbours) if vector else []
        return float(sigmoid(np.array(self.slope * self.vote(near) + self.intercept))), near


def unit_vector(counts: Counter[int], idf: np.ndarray) -> dict[int, float]:
    """TF-IDF weights of length one."""
    weights = {t: (1 + math.log(n)) * idf[t] for t, n in counts.items()}
    norm = math.sqrt(sum(w * w for w in weights.values()))
    return {t: w / norm for t, w in sorted(weights.items())} if norm else {}


def _labelled(docs: DataFrame, labels: DataFrame, settings: Settings, text: str, doc_id: str, label: str) -> list:
    """Both classes' examples, bounded by `max_examples` each, and the sizes of the classes.

    Texts are fetched for the chosen rows only.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).select(
        F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__toxic")
    )
    # A row that is labelled twice counts as toxic if any label says so.
    known = known.groupBy("__id").agg(F.max("__toxic").alias("__toxic"))
    known = known.join(docs.select(F.col(doc_id).alias("__id")), "__id", "left_semi")
    sizes = {r["__toxic"]: r["count"] for r in known.groupBy("__toxic").count().collect()}
    chosen = [
        r
        for value in (0, 1)
        for r in known.where(F.col("__toxic") == value)
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(settings.max_examples)
        .collect()
    ]
    if not chosen:
        return []
    spark = docs.sparkSession
    # As Arrow data; rows would go through Python workers of their own kind, which executors keep.
    columns = [pa.array([r[f.name] for r in chosen], to_arrow_type(f.dataType)) for f in known.schema.fields]
    wanted = spark.createDataFrame(pa.table(columns, known.schema.names), known.schema)
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(wanted), "__id")
    # A chosen id that several rows have stands for the least of their texts.
    found = rows.groupBy("__id", "__toxic").agg(F.min("__text").alias("__text")).collect()
    return [(str(r["__id"]), r["__toxic"], r["__text"], sizes[r["__toxic"]]) for r in sorted(found, key=lambda r: r["__id"])]


def _choose_terms(examples: Iterable[tuple[set[bytes], int]], settings: Settings) -> list[bytes]:
    """The terms of highest chi-square against the label."""
    held: tuple[Counter[bytes], Counter[bytes]] = (Counter(), Counter())
    sizes = [0, 0]
    for terms, toxic in examples:
        held[toxic].update(terms)
        sizes[toxic] += 1
    total, scored = sum(sizes), []
    for term in held[0].keys() | held[1].keys():
        a, b = held[1][term], held[0][term]
        with_it, without = a + b, total - a - b
        if with_it < 3 or not without or not all(sizes):
            continue
        chi = total * (a * (sizes[0] - b) - b * (sizes[1] - a)) ** 2 / (with_it * without * sizes[0] * sizes[1])
        share = (a + 0.5) * sizes[0] / ((b + 0.5) * sizes[1])
        if chi >= settings.min_chi and max(share, 1 / share) >= settings.lift:
            scored.append((-chi, term))
    return [term for _, term in sorted(scored)[: settings.max_terms]]


def document_frequencies(docs: DataFrame, text: str, numbers: dict[bytes, int], settings: Settings) -> tuple[int, np.ndarray]:
    """The number of rows, and of rows with each term, over all of `docs`."""

    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, held, rows = Terms(numbers, settings.prefixes), Counter(), 0
        for batch in batches:
            for value in batch.column(0):
                held.update(terms.count(value.as_py()).keys())
            rows += batch.num_rows
        pairs = [(-1, rows), *held.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in pairs], pa.int32()), pa.array([p[1] for p in pairs], pa.int64())], ["term", "n"]
        )

    sums = docs.select(text).mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in sums.collect()}  # a row for each of the max_terms terms at most
    return found.pop(-1, 0), np.array([found.get(t, 0) for t in range(len(numbers))], np.int64)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    settings: Settings | None = None,
    text: str = "text",
    doc_id: str = "doc_id",
    label: str = "toxic",
    corpus: DataFrame | None = None,
) -> Model:
    """Fit on the rows of `docs` that `labels` covers.

    Vectors have the chosen terms only (`Settings`): the cosine is that of the texts cut to
    these, and a text without any of them has no neighbours. Document frequencies come from all
    rows of `corpus` (by default `docs`), which is read once for that. The vote is calibrated on the examples themselves, each scored without
    itself, and weighted so that both classes have their share among all labelled rows.
    """
    settings = settings or Settings()
    examples = _labelled(docs, labels, settings, text, doc_id, label)
    # One example's terms at a time; those of all examples would take more memory than their texts.
    term_sets = ((text_terms(t, settings.prefixes), toxic) for _, toxic, t, _ in examples)
    numbers = {t: n for n, t in enumerate(_choose_terms(term_sets, settings))}
    rows, held = (
        document_frequencies(corpus if corpus is not None else docs, text, numbers, settings)
        if numbers
        else (0, np.zeros(0, np.int64))
    )
    idf = np.log((1 + rows) / (1 + held)) + 1
    terms = Terms(numbers, settings.prefixes)
    vectors = [unit_vector(terms.count(t), idf) for _, _, t, _ in examples]
    toxic = np.array([y for _, y, _, _ in examples], np.int64)
    index = BlockMaxIndex(vectors, len(numbers), settings.block)
    model = Model(settings, numbers, idf, index, [n for n, _, _, _ in examples], toxic)
    votes = np.array([model.vote(index.nearest(v, settings.neighbours, but=i)) for i, v in enumerate(vectors)])
    taken = Counter(toxic.tolist())
    weight = np.array([size / taken[y] for _, y, _, size in examples])
    if len(weight):
        weight *= len(weight) / weight.sum()
    model.slope, model.intercept = fit_platt(votes, toxic, weight) if len(votes) else (0.0, 0.0)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", result: str = "toxicity") -> DataFrame:
    """`docs` with a struct column: the calibrated score, and the neighbours that voted.

    Only the text enters. A text without any known term (null and empty ones too) has no
    neighbours and gets the score of a vote of nought. Equal texts get equal scores; ties in
    similarity go to the example of smaller row. Without any usable label every score is 0.5.
    Other columns pass through, except that one called `result` is replaced. The model, of at
    most 2 * max_examples examples and max_terms terms, goes to each task.
    """

    def make():  # noqa: ANN202
        terms = Terms(model.numbers, model.settings.prefixes)
        plain = model.score({})[0]

        def compute(batch: pa.RecordBatch) -> pa.Array:
            out = []
            for value in batch.column(text):
                counts = terms.count(value.as_py())
                if not counts:
                    out.append({"score": plain, "evidence": []})
                    continue
                scored, near = model.score(unit_vector(counts, model.idf))
                evidence = [
                    {"example": model.names[row], "similarity": s, "toxic": int(model.toxic[row])} for s, row in near
                ]
                out.append({"score": scored, "evidence": evidence})
            return pa.array(out, ARROW_RESULT)

        return compute

    return with_result(docs, result, RESULT, make)
