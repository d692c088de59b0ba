from __future__ import annotations

import difflib
import random

import numpy as np

from pricetide.llm.substring_dedup import Settings, chunk_ends, reach_left, reach_right, repeated_passages
from tests.llm.helpers import awkward_texts, documents, sentence


def test_boundaries_do_not_move_with_what_stands_before():
    rng = np.random.default_rng(3)
    passage = rng.integers(97, 123, 4000).astype(np.uint8)
    alone = chunk_ends(passage, np.array([0, 4000]), 24)
    for shift in (1, 7, 500):
        text = np.concatenate([rng.integers(97, 123, shift).astype(np.uint8), passage])
        ends = chunk_ends(text, np.array([0, len(text)]), 24) - shift
        assert set(alone[alone > 32]) <= set(ends) and set(ends[ends > 32]) == set(alone[alone > 32])
    both = chunk_ends(np.concatenate([passage, passage]), np.array([0, 4000, 8000]), 24)
    assert both.tolist() == [*alone, *(alone + 4000)]


def test_long_passages_are_found_and_clean_texts_left(spark):
    rng = random.Random(12)
    passage, short = sentence(rng, 70), sentence(rng, 8)
    clean = [f"{sentence(rng, 60)} {short} {sentence(rng, 30)}" for _ in range(10)]
    holders = [f"{sentence(rng, rng.randint(0, 40))} {passage} {sentence(rng, 15)}" for _ in range(12)]
    texts = clean + holders
    rows = repeated_passages(documents(spark, texts)).collect()
    assert {r["doc_id"] for r in rows} == set(range(11, 22))
    for r in rows:
        assert r["source_ids"] == [10] and r["n_words"] >= 20
        # A chunk or two that a clean text happens to have may adjoin the passage.
        at = texts[r["doc_id"]].find(passage)
        inside = min(r["end"], at + len(passage)) - max(r["start"], at)
        assert inside >= 0.6 * len(passage) and r["end"] - r["start"] - inside <= 40


def test_awkward_rows(spark):
    texts = awkward_texts()
    rows = repeated_passages(documents(spark, texts)).collect()
    long = next(i for i, t in enumerate(texts) if t and len(t) > 60_000)
    assert [(r["doc_id"], r["source_ids"], r["start"], r["end"]) for r in rows] == [(long + 1, [long], 0, len(texts[long]))]
    assert repeated_passages(documents(spark, [])).collect() == []
    same = sentence(random.Random(1), 50)
    assert repeated_passages(documents(spark, [same, same, same], [3, 3, None])).collect() == []
    twice = repeated_passages(documents(spark, [same, same, same], [3, 5, 5])).collect()
    assert [(r["doc_id"], r["source_ids"]) for r in twice] == [(5, [3])]


def test_result_does_not_depend_on_the_filter(spark):
    rng = random.Random(2)
    base = sentence(rng, 200)
    texts = [base, sentence(rng, 20) + " " + base[100:700], sentence(rng, 90)]
    want = sorted(map(tuple, repeated_passages(documents(spark, texts)).collect()))
    found = repeated_passages(documents(spark, texts), settings=Settings(filter_bits=8))
    assert sorted(map(tuple, found.collect())) == want and want


def test_short_passages_are_found_to_their_ends(spark):
    rng = random.Random(31)
    texts, planted = [], []
    for n in range(300):
        passage = sentence(rng, rng.randint(51, 60))
        # "#" and "%" stand around the passages and nowhere else.
        texts.append(f"{sentence(rng, 30)} # {passage} # {sentence(rng, 30)}")
        planted.append((n, f"{sentence(rng, rng.randint(0, 40))} % {passage} % {sentence(rng, rng.randint(0, 40))}", passage))
    docs = documents(spark, texts + [t for _, t, _ in planted])
    rows = {r["doc_id"]: r for r in repeated_passages(docs).collect()}
    assert set(rows) == {300 + n for n, _, _ in planted}
    for n, text, passage in planted:
        row = rows[300 + n]
        assert text[row["start"] : row["end"]] == f" {passage} " and row["source_ids"] == [n]
        assert row["n_words"] == len(passage.split())


def test_extension_cuts_no_character():
    e, yes = "xé mid".encode(), "yè mid".encode()
    # The second bytes of é and è differ, the first are the same.
    assert reach_left(e, yes, True) == (4, 1) and reach_left("é mid".encode(), "é mid".encode(), True) == (5, 2)
    assert reach_left(b"abc de", b"abc de", False) == (5, 1)
    assert reach_right("d é".encode(), "d è".encode(), True) == (2, 0)
    assert reach_right(b"d e", b"d e", True) == (3, 1) and reach_right(b"d e", b"d e", False) == (3, 2)
    assert reach_left(b"", b"x", True) == reach_right(b"x", b"", False) == (0, 0)


def brute_passages(texts: list[str], least: int) -> dict[int, set[tuple[int, int]]]:
    """All maximal stretches of each text that an earlier one has, of `least` words or more, joined."""
    out = {}
    for n, text in enumerate(texts):
        covered = np.zeros(len(text), bool)
        for source in texts[:n]:
            for m in difflib.SequenceMatcher(None, text, source, autojunk=False).get_matching_blocks():
                if len(text[m.a : m.a + m.size].split()) >= least:
                    covered[m.a : m.a + m.size] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], covered, [0]])))
        out[n] = set(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
    return {n: found for n, found in out.items() if found}


def test_equal_to_comparing_all_texts(spark):
    rng = random.Random(5)
    passages = [sentence(rng, rng.randint(40, 90)) for _ in range(6)]
    texts = []
    for n in range(14):
        # A letter stands around the passages, another for each text, so that no end is ambiguous.
        mark = f" {chr(65 + n)} "
        parts = [sentence(rng, 25)]
        for passage in rng.sample(passages, 2):
            parts += [passage, sentence(rng, 25)]
        texts.append(mark.join(parts))
    want = brute_passages(texts, 30)
    got: dict[int, set[tuple[int, int]]] = {}
    for r in repeated_passages(documents(spark, texts), settings=Settings(least_words=30)).collect():
        got.setdefault(r["doc_id"], set()).add((r["start"], r["end"]))
    assert len(want) >= 8 and got == want


def test_runs_of_one_byte_and_periods(spark):
    texts = [c * 20_000 for c in "abcdefghijklmnopqrstuvwxyz"] * 2 + ["ab cde " * 3_000] * 2
    rows = repeated_passages(documents(spark, texts)).collect()
    assert [(r["doc_id"], r["start"], r["end"], r["n_words"]) for r in rows] == [(53, 0, 21_000, 6_000)]
