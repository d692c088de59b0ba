from __future__ import annotations

import random

import sentencepiece

from pricetide.llm import sentencepiece_chunks
from pricetide.llm.queries import piece_model
from tests.llm.helpers import awkward_texts, documents


def test_ids_and_text_are_the_librarys(spark, monkeypatch):
    rng = random.Random(2)
    odd = "▁ ▁aé日\n\t\x00​<s>😀ﬁ0x"
    texts = awkward_texts() + ["".join(rng.choice(odd) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    model = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    rows = sentencepiece_chunks.encode_and_decode(documents(spark, texts), piece_model()).collect()
    rows.sort(key=lambda r: r["doc_id"])
    for row, text in zip(rows, texts, strict=True):
        ids = model.encode(text or "")
        assert row["pieces"]["ids"] == ids
        assert row["pieces"]["decoded"] == model.decode(ids)
        assert row["text"] == text


def test_table_that_starts_anew(monkeypatch):
    monkeypatch.setattr(sentencepiece_chunks, "TABLE_ROWS", 3)
    table = sentencepiece_chunks.ChunkTable(piece_model())
    for text in ("some words here", "other words there now", "some words", ""):
        ids, offsets, decoded = table.segment([text, None, text])
        whole = table.model.encode(text)
        assert ids[: offsets[1]].tolist() == whole and decoded == [text, "", text]


def test_empty_table(spark):
    assert sentencepiece_chunks.encode_and_decode(documents(spark, []), piece_model()).collect() == []
