"""The pipeline's stages against brute force, on a small corpus with planted cases."""

from __future__ import annotations

import random

import pytest
import sentencepiece

import corpus_pipeline
from pricetide.llm.queries import piece_model
from tests.llm.helpers import awkward_texts, documents, sentence
from tests.llm.test_decontamination import brute as contamination
from tests.llm.test_ngram_jaccard import brute as classes
from tests.llm.test_ngram_jaccard import near_copies
from tests.llm.test_secret_scan import brute as secrets

BAD = ["grubel", "snarfig", "mokkt"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    bench = [(i, sentence(rng, 30)) for i in range(4)]
    texts = awkward_texts()
    texts += [" ".join([*sentence(rng, 20).split(" "), *BAD, *sentence(rng, 10).split(" ")]) for _ in range(40)]
    texts += [sentence(rng, rng.randint(20, 60)) for _ in range(120)]
    texts += near_copies(rng, sentence(rng, 90), 12, 3)
    texts += [f"{sentence(rng, 30)} {bench[i][1]} {sentence(rng, 9)}" for i in range(4)]
    texts += [f"{sentence(rng, 25)} password=hunter2{i} {sentence(rng, 5)} {'0123456789abcdef' * 2}" for i in range(5)]
    rng.shuffle(texts)
    folder = str(tmp_path_factory.mktemp("corpus"))
    documents(spark, texts).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, 1, int(bool(t) and BAD[0] in t)) for i, t in enumerate(texts)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, texts, bench


def test_stages_are_declared():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "SentencePiece encoding and decoding",
    ]


def test_run_matches_brute_force(spark, corpus):
    folder, texts, bench = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = {r["doc_id"]: r["text"] for r in stages["toxicity"](spark, docs, folder).collect()}
    assert set(kept) == {i for i, t in enumerate(texts) if not (t and BAD[0] in t)}
    rows = classes(list(kept.values()), list(kept))
    kept = {i: kept[i] for i, _, least, _ in rows if i == least}
    found = contamination(list(kept.values()), bench)
    kept = {i: t for (i, t), (n, hit, _) in zip(kept.items(), found, strict=True) if not (hit and 20 * hit >= n)}

    def redacted(text):
        out, at = "", 0
        for part in filter(None, secrets(text).split(",")):
            a, b = map(int, part.split(":")[1:])
            if a > at or at == 0:
                out += text[at:a] + "[secret]"
            at = max(at, b)
        return text if at == 0 else out + text[at:]

    kept = {i: redacted(t) for i, t in kept.items()}
    model = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(out) == set(kept) and sum("[secret]" in (t or "") for t in kept.values()) >= 5
    for i, text in kept.items():
        assert out[i]["text"] == text and out[i]["ids"] == model.encode(text or "")
        # A marker in the original comes back as the blank that it stands for.
        assert out[i]["round_trip"] == ("▁" not in (text or ""))
        assert out[i]["n_chars"] == (None if text is None else len(text))


def test_stages_keep_columns_and_take_empty_tables(spark, corpus):
    folder, _, _ = corpus
    docs = documents(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.collect() == []
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes


def test_one_of_repeated_rows_stays(spark, corpus):
    text = "one text that stands here twice over"
    docs = documents(spark, [text, text, text, None, None], [4, 4, 9, None, None])
    kept = corpus_pipeline.keep_one_of_each(spark, docs, corpus[0]).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept if r["text"]) == [("4", text)] and len(kept) == 3


def test_rows_of_one_id_with_different_texts_are_told_apart(spark, corpus):
    a, b, c = (sentence(random.Random(n), 40) for n in (1, 2, 3))
    for name in (int, lambda i: f"k{i}", lambda i: 2**63 - 10 + i, lambda i: i - 2**63):
        rows = [(3, a), (5, a), (5, b), (5, b), (4, c), (6, c), (6, a), (6, None), (6, ""), (7, b), (None, a)]
        ids = spark.createDataFrame([(n, None if i is None else name(i)) for n, (i, _) in enumerate(rows)], f"n long, doc_id {'string' if name(1) == 'k1' else 'long'}")
        texts = spark.createDataFrame([(n, t) for n, (_, t) in enumerate(rows)], "n long, text string")
        docs = ids.join(texts, "n").drop("n")
        found = sorted(((str(r["doc_id"]), r["text"]) for r in corpus_pipeline.keep_one_of_each(spark, docs, corpus[0]).collect()), key=str)
        want = [(3, a), (5, b), (4, c), (6, None), (6, ""), (None, a)]
        assert found == sorted(((str(None if i is None else name(i)), t) for i, t in want), key=str)
