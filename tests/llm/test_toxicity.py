from __future__ import annotations

import random

import numpy as np

from pricetide.llm import toxicity
from tests.llm.helpers import awkward_texts, documents, sentence

BAD = ["grubel", "snarfig", "mokkt", "zwibbel"]


def labelled(spark, n=160, seed=1):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        w = sentence(rng, rng.randint(8, 60)).split(" ")
        if i % 4 == 0:
            for word in rng.sample(BAD, 3):
                w.insert(rng.randrange(len(w)), word + rng.choice(["", "er", "!"]))
        texts.append(" ".join(w))
        labels.append((i, int(i % 4 == 0)))
    return texts, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_index_is_exact():
    rng = np.random.default_rng(4)
    vectors = []
    for _ in range(150):
        terms = rng.choice(40, rng.integers(0, 9), replace=False)
        weights = rng.random(len(terms))
        norm = np.sqrt((weights**2).sum()) or 1
        vectors.append({int(t): float(w / norm) for t, w in zip(terms, weights, strict=True)})
    index = toxicity.BlockMaxIndex(vectors, 40, 8)
    for i, v in enumerate(vectors[:60]):
        for but in (-1, i):
            scored = [(sum(w * u.get(t, 0) for t, w in v.items()), j) for j, u in enumerate(vectors) if j != but]
            want = sorted(((s, j) for s, j in scored if s > 0), key=lambda x: (-x[0], x[1]))[:5]
            found = index.nearest(v, 5, but)
            assert [round(s, 9) for s, _ in found] == [round(s, 9) for s, _ in want]


def test_unseen_rows_are_told_apart(spark):
    texts, labels = labelled(spark)
    model = toxicity.fit(documents(spark, texts), labels, toxicity.Settings(min_chi=8, block=16))
    fresh, truth = labelled(spark, 80, seed=2)
    rows = toxicity.score(documents(spark, fresh), model).collect()
    want = {r["doc_id"]: r["toxic"] for r in truth.collect()}
    assert all((r["toxicity"]["score"] >= 0.7) == bool(want[r["doc_id"]]) for r in rows)
    hit = next(r for r in rows if want[r["doc_id"]])
    assert hit["toxicity"]["evidence"][0]["toxic"] == 1 and hit["score"] == 1.5


def test_awkward_texts_and_bounds(spark):
    texts, labels = labelled(spark, 80)
    model = toxicity.fit(documents(spark, texts), labels, toxicity.Settings(max_examples=15, min_chi=4))
    assert len(model.names) == 30
    rows = toxicity.score(documents(spark, awkward_texts(), [None] * len(awkward_texts())), model).collect()
    assert all(0 <= r["toxicity"]["score"] <= 1 for r in rows) and len(rows) == len(awkward_texts())
    first = rows[0]["toxicity"]
    assert first["evidence"] == [] and first["score"] < 0.5


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(documents(spark, ["a", None]), none)
    assert [r["toxicity"]["score"] for r in toxicity.score(documents(spark, ["a", None]), model).collect()] == [0.5, 0.5]
    assert toxicity.score(documents(spark, []), model).collect() == []
    odd = spark.createDataFrame([(0, 1), (0, 0), (1, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    assert toxicity.fit(documents(spark, ["a b", "c"]), odd).toxic.tolist() == [1]


def test_examples_up_to_four_thousand_a_class_are_indexed(spark):
    rows = [(i, f"{BAD[i % 4]} w{i % 50}" if i % 2 else f"v{i % 40} w{i % 50}") for i in range(7000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    assert len(toxicity.fit(docs, labels).names) == 7000


def test_terms_of_one_example_are_held_at_a_time(spark, monkeypatch):
    import gc
    import weakref

    class Held(set):
        pass

    alive, most = [], 0
    plain = toxicity.text_terms

    def watched(text, prefixes):
        nonlocal most
        found = Held(plain(text, prefixes))
        alive.append(weakref.ref(found))
        gc.collect()
        most = max(most, sum(r() is not None for r in alive))
        return found

    monkeypatch.setattr(toxicity, "text_terms", watched)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    toxicity.fit(documents(spark, [f"word{i % 2} other{i}" for i in range(20)]), labels, toxicity.Settings(min_chi=1))
    assert len(alive) == 20 and most <= 3


def test_chosen_examples_start_no_python_workers_of_another_kind(spark, monkeypatch):
    texts, labels = labelled(spark, 40)
    docs = documents(spark, texts)
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", None)  # rows of Python go through it
    found = toxicity._labelled(docs, labels, toxicity.Settings(), "text", "doc_id", "toxic")
    assert [(x[0], x[1], x[2]) for x in found] == [(str(i), int(i % 4 == 0), t) for i, t in enumerate(texts)]
