from __future__ import annotations

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from pricetide.llm.common import CLEANUP, store
from pricetide.llm.ngram_jaccard import Settings, _fetch_sets, components, jaccard_classes, overlaps, set_digest, text_sets
from tests.llm.helpers import awkward_texts, documents, sentence, words


def gram_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts, ids):
    sets = [gram_set(t) for t in texts]
    linked = {
        (a, b)
        for a in range(len(texts))
        for b in range(len(texts))
        if a != b and sets[a] and sets[b] and ids[a] is not None and ids[b] is not None
        and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    }
    least = list(ids)
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            if least[b] < least[a]:
                least[a], changed = least[b], True
    links = [sum(x == a for x, _ in linked) for a in range(len(texts))]
    return sorted(
        ((ids[i], len(sets[i]), least[i], links[i]) for i in range(len(texts))), key=str
    )


def got(frame):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in frame.collect()), key=str)


def near_copies(rng, base, n, changes):
    out = []
    for _ in range(n):
        w = base.split(" ")
        for _ in range(rng.randint(0, changes)):
            w[rng.randrange(len(w))] = sentence(rng, 1)
        if rng.random() < 0.3:
            del w[rng.randrange(len(w))]
        out.append(" ".join(w))
    return out


@pytest.fixture
def corpus():
    rng = random.Random(3)
    texts = awkward_texts()
    for size in (30, 80, 200):
        texts += near_copies(rng, sentence(rng, size), 25, max(2, size // 25))
    passage = sentence(rng, 60)
    texts += [f"{sentence(rng, rng.randint(5, 40))} {passage} {sentence(rng, rng.randint(0, 20))}" for _ in range(25)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return texts, ids


@pytest.mark.parametrize("settings", [Settings(), Settings(chunk_sets=4, hot=3, bucket_rows=50, sketch_bits=8)])
def test_classes_match_brute_force(spark, corpus, settings):
    texts, ids = corpus
    ids = [None if i % 17 == 3 else i for i in ids]
    assert got(jaccard_classes(documents(spark, texts, ids), settings=settings)) == brute(texts, ids)


def test_empty_table_and_repeated_rows(spark):
    assert jaccard_classes(documents(spark, [])).collect() == []
    twice = documents(spark, ["a b c d e f", "a b c d e f", "g"], [4, 4, 7])
    assert got(jaccard_classes(twice)) == [(4, 2, 4, 1), (4, 2, 4, 1), (7, 1, 7, 0)]


def test_overlaps_are_derived_exactly():
    rng = np.random.default_rng(1)
    base = rng.choice(500, 80, replace=False)
    sets = [np.unique(np.concatenate([base[rng.random(80) < 0.93], rng.integers(0, 600, 4)])).astype(np.uint64) for _ in range(30)]
    sets += [np.unique(rng.integers(0, 900, 50)).astype(np.uint64) for _ in range(10)]
    for x, row in overlaps(sets, Settings()):
        assert row.tolist() == [len(np.intersect1d(sets[x], y)) for y in sets]


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    found = components(spark.createDataFrame(edges, "a long, b long"))
    want = {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert {r["id"]: r["component"] for r in found.collect()} == want


def test_stored_steps_leave_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}

    setting, before = spark.conf.get(CLEANUP), shuffled()
    stored = store(spark.range(1000).repartition(3, "id"))
    assert spark.conf.get(CLEANUP) == setting
    # Files go a moment after the write.
    until = time.monotonic() + 10
    while shuffled() - before and time.monotonic() < until:
        time.sleep(0.2)
    assert not shuffled() - before
    assert stored.count() == 1000


def test_texts_that_are_no_node_stay_out_of_the_join(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('some words of text number ', id) AS text")
    name = set_digest(text_sets(pa.array(["some words of text number 7"]), 5)[0])[0]
    nodes = spark.createDataFrame([(7, name)], "id long, set long")
    classes = spark.sparkContext.broadcast(np.zeros(1 << 20, np.uint8))
    met = []
    monkey = DataFrame.join

    def join(self, other, *args):
        met.append(self.count())
        return monkey(self, other, *args)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(DataFrame, "join", join)
        found = _fetch_sets(docs, nodes, "doc_id", "text", classes, Settings()).collect()
    assert [(r["id"], r["set"], len(r["tokens"])) for r in found] == [(7, name, 16)]
    assert met[0] < 20


def test_a_task_has_one_python_worker_where_sets_are_fetched(spark):
    from types import SimpleNamespace

    # So few nodes would be broadcast, and both Python steps would run in one stage.
    docs = documents(spark, ["a b c d e f", "g h i"])
    nodes = spark.createDataFrame([(0, set_digest(text_sets(pa.array(["a b c d e f"]), 5)[0])[0])], "id long, set long")
    frame = _fetch_sets(docs, nodes, "doc_id", "text", SimpleNamespace(value=np.zeros(1 << 20, np.uint8)), Settings())
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") >= 2 and "BroadcastHashJoin" not in plan
    assert [r["id"] for r in frame.collect()] == [0]
