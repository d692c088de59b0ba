"""Filter interactions against counting row by row."""

from __future__ import annotations

import random
from itertools import permutations

import numpy as np

from pricetide.llm.filter_audit import _words, absent, audit, interactions, union
from tests.llm.helpers import WORD, awkward_texts, documents, sentence


def brute(rows: list[tuple], letters: str = "ABCDE") -> dict:
    """rows: (part, set of failing letters, good, toxic)."""
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys(letters, 0)
        found = {}
        for order in permutations(letters):
            left = mine
            for step, letter in enumerate(order, 1):
                here = [r for r in left if letter in r[1]]
                left = [r for r in left if letter not in r[1]]
                shapley[letter] += len(here)
                failing = sum(letter in r[1] for r in mine)
                alone = sum(r[1] == {letter} for r in mine)
                lost = (sum(r[2] for r in here), sum(r[3] for r in here))
                found["".join(order), step] = (len(left), len(here), failing - len(here), alone, *lost)
        for (order, step), values in found.items():
            out[part, order, step] = (*values, shapley[order[step - 1]])
    return out


def result(frame) -> dict:
    return {tuple(r)[:3]: tuple(r)[3:] for r in frame.collect()}


def test_galloping_merges():
    rng = random.Random(1)
    for _ in range(200):
        a, b = (np.array(sorted(rng.sample(range(300), rng.choice([0, 1, 5, 90, 250]))), np.int64) for _ in range(2))
        assert absent(a, b).tolist() == sorted(set(a.tolist()) - set(b.tolist()))
        assert union(a, b).tolist() == sorted(set(a.tolist()) | set(b.tolist()))


def test_words_of_long_texts_are_whole():
    text = sentence(random.Random(3), 400_000).encode()
    assert _words(text) == (len(text.split()), len(set(text.split())))
    assert _words(b"x" * 3_000_000 + b" x") == (2, 2)
    assert _words(b" ") == (0, 0)


def test_awkward_documents(spark):
    rng = random.Random(4)
    texts = [*awkward_texts(), "UPPER CASE here", "# odd $", " ".join(["same"] * 300), "A" + sentence(rng, 260)]
    texts += [sentence(rng, 250) for _ in range(4)]
    ids = list(range(len(texts)))
    ids[3] = ids[4] = None
    ids[6] = ids[5]  # one id twice, with the same text
    parts = [None, "", "en", "fr"]
    frame = documents(spark, texts, ids)
    langs = [parts[i % 4] for i in range(len(texts))]
    frame = spark.createDataFrame(
        [(i, t, p, 1, "x") for i, t, p in zip(ids, texts, langs, strict=True)],
        "doc_id long, text string, lang string, row int, part string",
    )
    label_rows = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, len(texts), 2)] + [(None, 1, 1), (8, 1, 0)]
    labels = spark.createDataFrame(label_rows, "doc_id long, quality int, toxic int")
    rows = []
    for i, t, p in zip(ids, texts, langs, strict=True):
        t = t or ""
        w = WORD.findall(t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u in zip(ids, texts, strict=True)),
        }
        mine = [r for r in label_rows if i is not None and r[0] == i]
        rows.append((p or "", {k for k, v in fails.items() if v}, any(r[1] == 1 for r in mine), any(r[2] == 1 for r in mine)))
    assert result(audit(frame, labels)) == brute(rows)
    assert audit(frame.limit(0), labels).count() == 0
    assert result(audit(frame, labels.limit(0))) == brute([(p, f, False, False) for p, f, _, _ in rows])


def test_any_filters_and_marks(spark):
    rng = random.Random(6)
    data = [(rng.choice(["a", "b"]), i // 2, i, rng.random() < 0.4, rng.choice([True, None, False]), rng.random() < 0.2) for i in range(500)]
    frame = spark.createDataFrame(data, "part string, id long, row long, P boolean, Q boolean, seen boolean")
    got = result(interactions(frame, "PQ", ["seen"]))
    rows = [(d[0], {n for n, v in zip("PQ", d[3:5], strict=True) if v}, d[5], False) for d in data]
    want = {k: (*v[:5], v[6]) for k, v in brute(rows, "PQ").items()}
    assert got == want
