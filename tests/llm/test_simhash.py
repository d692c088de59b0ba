"""SimHash classes against brute force."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from pricetide.llm.simhash import BITS, bucket_roots, covering_masks, mask_levels, near_links, simhash_classes
from tests.llm.helpers import awkward_texts, documents, sentence, words


def brute_fingerprint(text: str | None, width: int = 3) -> int:
    found = words(text)
    grams = [" ".join(found[i : i + width]) for i in range(len(found) - width + 1)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(BITS) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(points: dict, radius: int = 2) -> dict:
    """Least key of each key's component, keys being linked by their fingerprints."""
    least = {k: k for k in points}
    changed = True
    while changed:
        changed = False
        for a, b in combinations(points, 2):
            if (points[a] ^ points[b]).bit_count() <= radius and least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    return least


def test_masks_cover_every_two_bits():
    for free in ((1 << BITS) - 1, 0x0FF0F0F0123456, 0b1011):
        masks = covering_masks(free, 2)
        places = [i for i in range(BITS) if free >> i & 1]
        assert len(masks) == 7 and all(m & ~free == 0 for m in masks)
        for a, b in combinations(places, 2):
            assert any(not m >> a & 1 and not m >> b & 1 for m in masks)


def test_last_level_leaves_small_buckets():
    assert [len(x) for x in mask_levels(2, 3)] == [7, 49, 343]
    assert max(BITS - m.bit_count() for m in mask_levels(2, 3)[-1]) <= 6


def test_roots_of_a_chain():
    chain = np.array([0, 0b11, 0b1111, 0b111111, 0b111 << 40], np.uint64)
    assert bucket_roots(chain, 2).tolist() == [0, 0, 0, 0, 4]


def test_awkward_texts(spark):
    texts = awkward_texts()
    rng = random.Random(2)
    base = sentence(rng, 400)
    for i in range(12):  # near copies
        changed = base.split(" ")
        changed[i * 30] = "changed"
        texts.append(" ".join(changed))
    long = sentence(rng, 60) * 6_000  # several parts of a text, none ends at a word
    texts += [long, long[:-1] + "\n" + long[-1]]
    frame = documents(spark, texts)
    got = {r["doc_id"]: (r["fingerprint"] % 2**64, r["component_id"]) for r in simhash_classes(frame).collect()}
    prints = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    least = brute_classes(prints)
    assert got == {i: (prints[i], least[i]) for i in prints}


def test_ids_null_repeated_and_empty_table(spark):
    texts = ["", "alpha beta gamma delta", "alpha beta gamma delta", None, "quite another text this is", ""]
    frame = documents(spark, texts, [None, 7, 7, 3, 7, 9])
    rows = sorted(((r["doc_id"] or -1, r["component_id"]) for r in simhash_classes(frame).collect()), key=repr)
    assert rows == sorted([(-1, None), (3, 3), (9, 3), (7, 7), (7, 7), (7, 7)], key=repr)
    assert simhash_classes(frame.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [2, 8, 512])
def test_split_buckets_lose_no_link(spark, bucket):
    rng = random.Random(bucket)
    points = set()
    for _ in range(12):
        center = rng.getrandbits(64)
        points.add(center)
        for _ in range(40):
            points.add(center ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = {p - (1 << 64) if p >> 63 else p: p for p in points}
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    edges = [(r["a"], r["b"]) for r in near_links(nodes, bucket=bucket).collect()]
    # Edges join only what links join, and all of it.
    expected = brute_classes(signed)
    least = {p: p for p in signed}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    assert least == expected
