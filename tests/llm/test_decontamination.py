from __future__ import annotations

from collections import defaultdict
import re

from pricetide.llm.decontamination import is_contaminated, mark_contamination
from tests.llm.helpers import LOWER, awkward_texts, documents, sentence

RX = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def normal(text):
    return RX.findall((text or "").translate(LOWER))


def brute(texts, items):
    windows = defaultdict(set)
    for name, text in items:
        w = normal(text) if name is not None else []
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].add(str(name))
    out = []
    for t in texts:
        w, hit, names = normal(t), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                found = windows.get(tuple(w[i : i + size]))
                if found:
                    names |= found
                    hit |= set(range(i, i + size))
        out.append((len(w), len(hit), sorted(names)))
    return out


def cases():
    import random

    rng = random.Random(9)
    items = [(i, sentence(rng, 30)) for i in range(6)] + [
        (6, "Short item!"), (7, None), (8, ""), (9, "..."), (None, "lonely words here"), (0, sentence(rng, 20)), (10, "SHORT item"),
    ]
    texts = awkward_texts() + [
        f"{sentence(rng, 10)} {items[1][1].upper()}? {sentence(rng, 5)}",
        f"x {' '.join(items[2][1].split()[3:17])} y {' '.join(items[3][1].split()[:12])}",
        "a Short—item, short ITEM.",
        "lonely words here",
    ]
    return texts, items


def test_matches_brute_force_in_one_block_and_several(spark):
    texts, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(texts, items)
    for block_chars in (16_000_000, 300):
        rows = mark_contamination(documents(spark, texts), bench, block_chars=block_chars).collect()
        rows.sort(key=lambda r: r["doc_id"])
        found = [r["contamination"] for r in rows]
        assert [(f["n_words"], f["n_hit"], f["items"]) for f in found] == want


def test_spans_lie_in_the_original(spark):
    texts, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    for row in mark_contamination(documents(spark, texts), bench).where("contamination.n_hit > 0").collect():
        found = row["contamination"]
        inside = [w for s in found["spans"] for w in normal(row["text"][s["start"] : s["end"]])]
        assert len(inside) == found["n_hit"]


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert mark_contamination(documents(spark, []), bench).collect() == []
    rows = mark_contamination(documents(spark, ["a b", None]), bench).where(is_contaminated()).collect()
    assert rows == []
