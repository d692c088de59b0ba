"""Source divergence against exact integers, term by term."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pricetide.llm import source_divergence
from pricetide.llm.source_divergence import parts_of, term_pieces
from tests.llm.helpers import LOWER, awkward_texts, sentence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows: list[tuple], min_docs: int = 3, top: int = 200) -> set[tuple]:
    """rows: (lang, source, text)."""
    docs, langs, held = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for lang, source, text in ((a or "", b or "", t or "") for a, b, t in rows):
        found = Counter(TERM.findall(text.translate(LOWER)))
        groups.add((lang, source))
        docs[lang].update(found.keys())
        langs[lang].update(found)
        held[lang, source].update(found)
    out = set()

    def ranked(group, part, values, limit=None):
        order = sorted(values.items(), key=lambda x: (-x[1], x[0].encode()))
        out.update((*group, part, item, value, i) for i, (item, value) in enumerate(order[:limit], 1))

    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        whole = shares(langs[lang])
        mine = {s: shares(held[lang, s]) for g, s in groups if g == lang}
        for s, p in mine.items():
            others = {o: sum((p[t] - q[t]) ** 2 // q[t] for t in kept) for o, q in mine.items() if o != s}
            ranked((lang, s), "pair", others)
            above = {t: (p[t] - whole[t]) ** 2 // whole[t] for t in kept if held[lang, s][t] and p[t] > whole[t]}
            ranked((lang, s), "term", above, top)
    return out


def some_rows() -> list[tuple]:
    rng = random.Random(8)
    texts = [*awkward_texts(), *(sentence(rng, rng.randint(5, 200)) for _ in range(40)), "it's A_b c9d été ÉTÉ\x7fz", "café it's"]
    rows = [(rng.choice(["en", "fr", None, ""]), rng.choice(["s1", "s2", None, "", "é"]), t) for t in texts]
    return [*rows, ("xx", "alone", "one two"), ("yy", "a", None), ("yy", "b", "1 2 3")]


@pytest.mark.parametrize("block_terms", [1, 50, source_divergence.BLOCK_TERMS])
def test_awkward_rows(spark, monkeypatch, block_terms):
    rows = some_rows()
    frame = spark.createDataFrame([(*r, 1, "t") for r in rows], "lang string, source string, text string, n int, term string")
    found = source_divergence.source_divergence(frame.repartition(3), block_terms=block_terms)
    assert {tuple(r) for r in found.collect()} == brute(rows)


def test_terms_over_the_top_and_slices(spark, monkeypatch):
    rows = some_rows()
    monkeypatch.setattr(source_divergence, "PAIR_ROWS", 7)
    monkeypatch.setattr(source_divergence, "HELD_PAIRS", 3)
    frame = spark.createDataFrame(rows, "lang string, source string, text string")
    found = source_divergence.source_divergence(frame, min_docs=1, top=4)
    assert {tuple(r) for r in found.collect()} == brute(rows, 1, 4)


def test_empty_table(spark):
    frame = spark.createDataFrame([], "lang string, source string, text string")
    assert source_divergence.source_divergence(frame).count() == 0


def test_pieces_of_a_long_text():
    text = (sentence(random.Random(1), 300_000)).encode()
    joined = [t for terms in term_pieces(text) for t in terms]
    assert joined == [t.encode() for t in TERM.findall(text.decode().translate(LOWER))]


def test_shares_are_exact_for_large_counts(spark):
    cases = [(9 * 10**14, 9 * 10**15 - 5, 7), (0, 10**15, 10**6), (10**15 - 1, 10**15 - 1, 1)]
    frame = spark.createDataFrame(cases, "n long, total long, kept long")
    got = [r[0] for r in frame.select(parts_of(F.col("n"), F.col("total"), F.col("kept"))).collect()]
    assert got == [1 + 10**9 * (n + 1) // (t + k) for n, t, k in cases]
