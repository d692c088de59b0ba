"""Source divergence audit: how the term frequencies of a language's sources differ.

1. Every task indexes its texts in memory: for each (lang, source) the terms' occurrences and the
   documents that hold them. When the block is full it goes out as a run sorted by term.
2. Runs are dealt into shards by a hash of (lang, term). Spark's external sort merges the runs of
   a shard by a heap over what it spilled, and one pass over the merged rows adds them up to
   frequencies. Terms in too few documents of their language are dropped there.
3. All terms of a language count for a pair of sources, most of them absent from both. The sum
   for a pair is taken as if each source had only terms that the other lacks, which needs no more
   than how many of its terms occur how often. A last pass over the frequencies streams the
   corrections of the terms that two sources share.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pricetide.llm.common import small_batches, store

#: Term entries of a block (two counters each), rows of a run that go out together, and pairs of
#: rows that are compared at a time: they bound a task's memory.
BLOCK_TERMS = 400_000
RUN_ROWS = 50_000
PAIR_ROWS = 1_000_000
#: Pairs of sources whose corrections a task holds before it sends them on.
HELD_PAIRS = 500_000
SPLIT_BYTES = 1 << 20
#: Frequencies are in parts of 1000^3.
SCALE_DIGITS = 3

#: Letters of ASCII in lower case and all bytes of other characters; the rest separates terms.
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_RUN = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("lang", "source", "term")]
    + [T.StructField(c, T.LongType()) for c in ("n", "docs")]
)


def term_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, part by part if it is long."""
    rest = b""
    for at in range(0, len(text), SPLIT_BYTES):
        piece = rest + text[at : at + SPLIT_BYTES].translate(_TERM_BYTES)
        terms = piece.split()
        last = at + SPLIT_BYTES >= len(text)
        rest = b"" if last or not terms or piece.endswith(b" ") else terms.pop()
        yield terms


class Block:
    """The postings of a task's texts since the last run."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        self.size = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        occurrences, holders = self.groups.setdefault((lang, source), (Counter(), Counter()))
        before = len(occurrences)
        seen: set[bytes] = set()
        for terms in term_pieces(text):
            occurrences.update(terms)
            seen.update(terms)
        holders.update(seen)
        self.size += len(occurrences) - before + 1

    def run(self) -> Iterator[pa.RecordBatch]:
        """The block as one run in order of term; a row without a term names each group."""
        groups, self.groups, self.size = self.groups, {}, 0
        if not groups:
            return
        names = [pa.array(x, pa.string()) for x in zip(*groups, strict=True)]
        nothing = [pa.nulls(len(groups), k) for k in (pa.string(), pa.int64(), pa.int64())]
        yield pa.RecordBatch.from_arrays([*names, *nothing], names=_RUN.names)
        sizes = [len(occurrences) for occurrences, _ in groups.values()]
        terms, counts, docs = [], [], []
        for occurrences, holders in groups.values():
            terms.append(pa.array(occurrences, pa.binary(), size=len(occurrences)))
            counts.append(np.fromiter(occurrences.values(), np.int64, len(occurrences)))
            docs.append(np.fromiter(map(holders.__getitem__, occurrences), np.int64, len(occurrences)))
        places = np.repeat(np.arange(len(groups)), sizes)
        rows = pa.table(
            [names[0].take(pa.array(places)), names[1].take(pa.array(places)), pa.concat_arrays(terms)]
            + [pa.array(np.concatenate(x)) for x in (counts, docs)],
            names=_RUN.names,
        )
        rows = rows.take(pc.sort_indices(rows.column("term")))
        rows = rows.set_column(2, "term", rows.column("term").cast(pa.string()))
        yield from rows.to_batches(RUN_ROWS)


def index_runs(docs: DataFrame, text: str, lang: str, source: str, block_terms: int) -> DataFrame:
    """Rows (lang, source, term, n, docs) of sorted runs; a null term marks an occurring group."""
    small_batches(docs.sparkSession)
    none = F.lit("")
    taken = docs.select(
        F.coalesce(F.col(lang).cast("string"), none).alias("lang"),
        F.coalesce(F.col(source).cast("string"), none).alias("source"),
        F.coalesce(F.col(text), none).cast("binary").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()
        for batch in batches:
            names = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
            for (group, named), value in zip(names, batch.column("text"), strict=True):
                block.add(sys.intern(group), sys.intern(named), value.as_py())
                if block.size >= block_terms:
                    yield from block.run()
        yield from block.run()

    return taken.mapInArrow(run, _RUN)


def merged_frequencies(runs: DataFrame, min_docs: int) -> DataFrame:
    """Rows (lang, term, source, n, lang_n): the runs of each shard merged and added up.

    Only terms that at least `min_docs` documents of their language hold are left.
    """
    dealt = runs.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    merged = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    counted = merged.withColumns({"lang_n": F.sum("n").over(whole), "lang_docs": F.sum("docs").over(whole)})
    return counted.where(F.col("lang_docs") >= min_docs).select("lang", "term", "source", "n", "lang_n")


def parts_of(n: F.Column, total: F.Column, kept: F.Column) -> F.Column:
    """1 + floor(1000^3 * (n + 1) / (total + kept)), digit by digit in base 1000, so within a long."""
    below = total + kept
    rest, value = n + 1, F.lit(0).cast("long")
    for _ in range(SCALE_DIGITS):
        rest = rest * 1000
        value = value * 1000 + F.call_function("div", rest, below)
        rest = rest % below
    return value + 1


def divergence(p: F.Column, q: F.Column) -> F.Column:
    """floor((p - q)^2 / q) of two longs up to about 1000^3."""
    return F.call_function("div", (p - q) * (p - q), q)


def _starts(rows: pa.Table) -> np.ndarray:
    """True where a row's (lang, term) differs from the row's before it."""
    differs = np.ones(rows.num_rows, bool)
    if rows.num_rows > 1:
        here, before = rows.slice(1), rows.slice(0, rows.num_rows - 1)
        changed = [pc.not_equal(here.column(c).combine_chunks(), before.column(c).combine_chunks()) for c in ("lang", "term")]
        differs[1:] = pc.or_(*changed).to_numpy(zero_copy_only=False)
    return differs


def _corrections(shares: DataFrame) -> DataFrame:
    """Rows (lang, source, item, value): for each pair of sources, what the terms they share change.

    `shares` has lang, term, source, p and p0, the source's share of a term that it lacks.
    """
    schema = T.StructType(
        [T.StructField(c, T.StringType()) for c in ("lang", "source", "item")] + [T.StructField("value", T.LongType())]
    )

    def out(held: dict[tuple[str, str, str], int]) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in held], pa.string()) for i in range(3)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(list(held.values()), pa.int64())], names=schema.names)

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) * (p - q) // q

    def add(rows: pa.Table, held: dict[tuple[str, str, str], int]) -> Iterator[pa.RecordBatch]:
        """Add the pairs of all whole terms in `rows`."""
        rows = rows.combine_chunks()
        coded = [pc.dictionary_encode(rows.column(c)).combine_chunks() for c in ("lang", "source")]
        (langs, lang_names), (sources, source_names) = (
            (x.indices.to_numpy().astype(np.int64), x.dictionary.to_pylist()) for x in coded
        )
        terms = np.cumsum(_starts(rows)) - 1
        sizes = np.bincount(terms)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        p, p0 = rows.column("p").to_numpy(), rows.column("p0").to_numpy()
        mates = sizes[terms]
        ends = np.cumsum(mates)
        n = len(source_names)
        at = 0
        while at < len(terms):
            base = ends[at - 1] if at else 0
            last = max(at + 1, int(np.searchsorted(ends, base + PAIR_ROWS, side="right")))
            one = np.repeat(np.arange(at, last), mates[at:last])
            two = np.arange(len(one)) - np.repeat(ends[at:last] - mates[at:last] - base, mates[at:last]) + first[terms[one]]
            differ = one != two
            one, two = one[differ], two[differ]
            change = f(p[one], p[two]) - f(p[one], p0[two]) - f(p0[one], p[two]) + f(p0[one], p0[two])
            pairs, inverse = np.unique((langs[one] * n + sources[one]) * n + sources[two], return_inverse=True)
            sums = np.zeros(len(pairs), np.int64)
            np.add.at(sums, inverse, change)
            for pair, value in zip(pairs.tolist(), sums.tolist(), strict=True):
                key = (lang_names[pair // (n * n)], source_names[pair // n % n], source_names[pair % n])
                held[key] = held.get(key, 0) + value
            if len(held) >= HELD_PAIRS:
                yield out(held)
                held.clear()
            at = last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str, str], int] = {}
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(x.num_rows for x in waiting) < RUN_ROWS:
                continue
            rows = pa.Table.from_batches(waiting)
            # The last term may go on in the next batch.
            whole = int(np.flatnonzero(_starts(rows))[-1])
            yield from add(rows.slice(0, whole), held) if whole else ()
            waiting = rows.slice(whole).to_batches()
        if waiting:
            yield from add(pa.Table.from_batches(waiting), held)
        if held:
            yield out(held)

    sorted_shares = shares.sortWithinPartitions("lang", "term", "source")
    found = sorted_shares.select("lang", "term", "source", "p", "p0").mapInArrow(run, schema)
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    min_docs: int = 3,
    top: int = 200,
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): how each source's terms differ.

    Terms are runs of ASCII letters (A-Z lower-cased) and characters beyond ASCII. A language
    keeps the V terms that at least `min_docs` of its documents hold. A group (lang, source), and
    each language, gives a kept term that it holds n times of N kept ones the share
    p = 1 + floor(10^9 * (n + 1) / (N + V)); f(p, q) = floor((p - q)^2 / q).

    Part `pair`: item is each other source of the language, value the sum of f over all kept
    terms, q being its share. Part `term`: item is a kept term in the group with a share above
    the language's, q, and value f, only the first `top`. Ranks start at 1 for each group and
    part, by value descending and item in order of UTF-8.

    Null texts, languages and sources are empty. A group without terms has its pairs; a language
    without kept terms has pairs of value 0. A language with one source has no pairs. An empty
    table gives no row. Rows that repeat count each time. Values and counts are exact up to
    9 * 10^15 occurrences of a language. Other columns play no part.
    """
    runs = store(index_runs(docs, text, lang, source, block_terms))
    groups = runs.where("term IS NULL").select("lang", "source").distinct()
    terms = store(merged_frequencies(runs.where("term IS NOT NULL"), min_docs))
    held = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    vocabulary = terms.select("lang", "term", "lang_n").distinct()
    kept = vocabulary.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    zero = F.lit(0).cast("long")
    stats = groups.join(held, ["lang", "source"], "left").join(kept, "lang", "left")
    stats = store(stats.fillna(0, ["total", "terms", "kept", "lang_total"]))
    p0 = F.when(F.col("kept") > 0, parts_of(zero, F.col("total"), F.greatest("kept", F.lit(1)))).alias("p0")
    shares = terms.join(stats, ["lang", "source"]).select(
        "lang",
        "term",
        "source",
        "n",
        parts_of(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
        parts_of(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"),
        p0,
    )

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = shares.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value")
    )
    above = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    # How many of a group's terms have each share: all that a pair's base needs of it.
    heights = store(shares.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("times")))
    mates = stats.select("lang", F.col("source").alias("item"), F.col("terms").alias("item_terms"), p0.alias("item_p0"))
    apart = F.col("source") != F.col("item")
    here = heights.join(mates, "lang").where(apart)
    one_side = here.groupBy("lang", "source", "item").agg(
        F.sum(F.col("times") * divergence(F.col("p"), F.col("item_p0"))).alias("value")
    )
    other_side = here.groupBy(F.col("lang"), F.col("item").alias("source"), F.col("source").alias("item")).agg(
        F.sum(F.col("times") * divergence(F.col("item_p0"), F.col("p"))).alias("value")
    )
    absent = stats.select("lang", "source", "kept", "terms", p0).join(mates, "lang").where(apart).select(
        "lang",
        "source",
        "item",
        F.when(
            F.col("kept") > 0,
            (F.col("kept") - F.col("terms") - F.col("item_terms")) * divergence(F.col("p0"), F.col("item_p0")),
        ).otherwise(zero).alias("value"),
    )
    # The corrections read whole terms, so they are dealt by them.
    shared = _corrections(shares.repartition("lang", "term"))
    parts = absent.unionByName(one_side).unionByName(other_side).unionByName(shared)
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return pairs.unionByName(above)
