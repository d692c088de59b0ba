"""Small tables with the awkward cases, and brute-force versions of what operators do."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SYLLABLES = ["an", "ther", "ou", "ing", "ß", "éa", "st", "lo", "the", "ti", "日本"]


def sentence(rng: random.Random, n: int) -> str:
    """`n` invented words."""
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def awkward_texts() -> list[str | None]:
    """Null, empty, blank, tiny, repeated, very long, and with odd characters."""
    rng = random.Random(5)
    long = sentence(rng, 30_000)
    return [
        None,
        "",
        " \t\n ",
        "one",
        "ONE",
        "one two three four",
        "one two three four",
        "a\x00b \x1c c\x85d\xa0e " + sentence(rng, 40),
        "  lead  and trail  ",
        "▁marker ▁▁ in text",
        long,
        long,
        "x" * 50_000,
        *(sentence(rng, rng.randint(1, 120)) for _ in range(20)),
    ]


def documents(spark: SparkSession, texts: list[str | None], ids: list[int | None] | None = None) -> DataFrame:
    """A documents table whose further columns have names that operators use too."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", None, None if t is None else len(t), 1.5, "x") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, score double, id string"
    )


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))
