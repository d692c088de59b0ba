from __future__ import annotations

import random
from collections import Counter

from pricetide.llm import quality_rules
from tests.llm.helpers import WORD, awkward_texts, documents, sentence


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = t.split("\n")
    dup = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w),
    )


def test_counts_match_brute_force(spark):
    rng = random.Random(8)
    line = sentence(rng, 12)
    texts = awkward_texts() + [
        f"{line}\n{line}\n{line}", "\n\n \n \nx\nx\n y\n y", f"{line} {sentence(rng, 30)} {line}", "#*$%&|<> é#", "w " * 30,
        f"{line} end\n{line}\tend\r\n{line}",
    ]
    texts = [t if t is None or len(t) < 60_000 else t[:9000] for t in texts]
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_rules.fit(documents(spark, texts), none)
    rows = sorted(quality_rules.judge(documents(spark, texts), model).collect(), key=lambda r: r["doc_id"])
    names = list(quality_rules.COLUMNS)[:6]
    assert [tuple(r["quality"][n] for n in names) for r in rows] == [brute(t) for t in texts]
    assert all(r["quality"]["kept"] == (not r["quality"]["base_failed"]) for r in rows)
    assert quality_rules.judge(documents(spark, []), model).collect() == []


def test_learns_what_junk_is(spark):
    rng = random.Random(6)

    def some(n):
        good = [sentence(rng, rng.randint(25, 60)) for _ in range(n)]
        junk = [" ".join(w + rng.choice(["***", "$$$", "!!"]) for w in sentence(rng, 30).split(" ")) for _ in range(n // 3)]
        return good + junk, [1] * len(good) + [0] * len(junk)

    texts, truth = some(90)
    labels = spark.createDataFrame(list(enumerate(truth)), "doc_id long, quality int")
    model = quality_rules.fit(documents(spark, texts), labels, quality_rules.Settings(bits=14))
    fresh, want = some(45)
    rows = sorted(quality_rules.judge(documents(spark, fresh), model).collect(), key=lambda r: r["doc_id"])
    right = sum(r["quality"]["kept"] == bool(y) for r, y in zip(rows, want, strict=True))
    assert right >= 0.95 * len(want)
    assert {r["quality"]["kept"] for r in quality_rules.judge(documents(spark, [None, ""]), model).collect()} == {False}
