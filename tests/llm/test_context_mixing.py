from __future__ import annotations

import math
import pickle
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash

from pricetide.llm import context_mixing
from pricetide.llm.common import held_out
from pricetide.llm.context_mixing import DELTA, END, MOST, STEPS, STRETCH_PARTS, VALUE_PARTS, Lots
from pricetide.llm.context_mixing import Mixer, Settings, Sums, Table, add_counts, byte_grams, distinct_grams, score_texts
from tests.llm.helpers import awkward_texts, documents, sentence, words

SMALL = Settings(table_bits=(16, 14, 14, 15), shard_bytes=20_000)


def brute(rows):
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    counts = Counter(w for (_, t), h in zip(rows, held, strict=True) if not h for w in [*words(t), None])
    total, kinds = sum(counts.values()), len(counts)
    out = []
    for (i, t), h in zip(rows, held, strict=True):
        tokens = [*words(t), None]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens)
        out.append((str(i), h, len(tokens), sum(counts[w] > 0 for w in tokens), total, round(base, 6)))
    return sorted(out)


def check(spark, texts, ids):
    frame = score_texts(documents(spark, texts, ids), held_out(5), settings=SMALL)
    rows = frame.collect()
    found = sorted(
        (str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows
    )
    assert found == brute(list(zip(ids, texts, strict=True)))
    assert all(r["score"] < 0 and r["bits_per_byte"] > 0 for r in rows)
    return rows


def test_unigrams_match_brute_force(spark):
    rng = random.Random(4)
    texts = awkward_texts() + [sentence(rng, 30) for _ in range(30)]
    ids = [None if i % 11 == 5 else i - (i % 13 == 3) for i in range(len(texts))]
    check(spark, texts, ids)
    check(spark, ["Ab ab c", None, ""], [1, 1, 2])
    assert score_texts(documents(spark, []), held_out(5), settings=SMALL).collect() == []


def test_without_training_texts(spark):
    out = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    rows = check(spark, ["a b", "", "c"], out)
    assert {r["n_known"] for r in rows} == {0}


def grams_of(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return byte_grams(raw, np.array([0, len(raw)]), SMALL.orders)[0]


def grown(texts):
    counts = np.zeros((SMALL.starts[-1], 2, 2), np.int32)
    for t in texts:
        add_counts(counts, *distinct_grams(grams_of(t)), 0, SMALL)
    return Table.of(counts[:, 0, 0], counts[:, 0, 1])


def learnt(texts, table):
    mixer, sums = Mixer(SMALL), Sums.nought(SMALL)
    for t in texts:
        mixer.gather(sums, *distinct_grams(grams_of(t)), table)
    mixer.step(sums)
    return mixer


def test_probabilities_of_all_next_bytes_add_up_to_one():
    table = grown(["abc abd abe", "some text"])
    mixer = learnt(["abc abd"], table)
    for context in (0, 0x616263, 0x20616264):
        grams = (np.uint64(context) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert abs((10 ** mixer.log10(grams, table)).sum() - 1) < 1e-6


def test_learning_beats_what_it_began_with():
    rng = random.Random(7)
    texts = [sentence(rng, 60) for _ in range(40)]
    table = grown(texts[:20])
    mixer = learnt(texts[20:30], table)

    def total(m):
        found = 0.0
        for t in texts[30:]:
            grams, counts = distinct_grams(grams_of(t))
            found += (m.log10(grams, table) * counts).sum()
        return found

    bits = -total(mixer) / math.log10(2) / sum(len(t.encode()) + 1 for t in texts[30:])
    assert total(mixer) > total(Mixer(SMALL)) and bits < 4
    assert np.all(np.isfinite(mixer.weights))


def test_byte_grams_keep_texts_apart():
    data = np.frombuffer(b"abxyz", np.uint8)
    grams, places = byte_grams(data, np.array([0, 2, 2, 5]), 2)
    want = [0x61, 0x6162, 0x616200 | END, END, 0x78, 0x7879, 0x78797A, 0x797A00 | END]
    assert grams.tolist() == want and places.tolist() == [0, 3, 4, 8]


def scalar_mix(x):
    mask = (1 << 64) - 1
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
    return x ^ (x >> 31)


def scalar_bits(text, s):
    """(bit's place, slots of all orders, bit) for each bit of the text and its end."""
    data = [0] * s.orders + list(text.encode()) + [END]
    for at in range(s.orders, len(data)):
        for place in range(8):
            node = (1 << place) | (data[at] >> (8 - place))
            found = []
            for order, bits in enumerate(s.table_bits, 1):
                context = int.from_bytes(bytes(data[at - order : at]), "big")
                if order == 1:
                    found.append((order, context << 8 | node))
                else:
                    first = scalar_mix((context + (order << 56)) & ((1 << 64) - 1)) >> (64 - bits)
                    found.append((order, first ^ ((node * 0x9E3779B1) & ((1 << bits) - 1))))
            yield place, found, (data[at] >> (7 - place)) & 1


class ScalarMixer:
    """The same model, a bit at a time, with counts in dictionaries."""

    def __init__(self, texts, s):
        self.s, self.counts = s, [{}, {}]
        self.weights, self.refined, self.curve = {}, {}, {}
        sign = [xxhash.xxh64_intdigest(t.encode(), seed=42) for t in texts]
        parts = [(h >> 8) % (1 << s.doublings) for h in sign]
        steps = [p.bit_length() for p in parts]
        for t, h in zip(texts, sign, strict=True):
            for _, slots, bit in scalar_bits(t, s):
                for slot in slots:
                    self.counts[h % 2].setdefault(slot, [0, 0])[bit] += 1
        for step in range(s.doublings + 1):
            seen = {}
            for t, h, own in zip(texts, sign, steps, strict=True):
                if own == step:
                    for place, slots, bit in scalar_bits(t, s):
                        gate, x = self.look(place, slots, [1 - h % 2])
                        seen.setdefault(gate, []).append((x, bit, self.mixed(gate, x)))
            for gate, items in seen.items():
                self.learn(gate, items)

    def look(self, place, slots, sides):
        known, x = 0, []
        for slot in slots:
            both = [self.counts[side].get(slot, [0, 0]) for side in sides]
            zeros, ones = (sum(c[b] for c in both) for b in (0, 1))
            value = max(-MOST, min(MOST, math.log((ones + DELTA) / (zeros + DELTA))))
            x.append(round(value * STRETCH_PARTS) / STRETCH_PARTS)
            if n := zeros + ones:
                known = (slot[0] - 1) * 3 + 1 + (n > 1) + (n > 3)
        return (known, place), x

    def mixed(self, gate, x):
        weights = self.weights.get(gate, [0.4] * self.s.orders)
        return max(-7.9, min(7.9, sum(w * v for w, v in zip(weights, x, strict=True))))

    def refinement(self, gate):
        return self.refined.get(gate, [1 / (1 + math.exp(-(i / 2 - 8))) for i in range(STEPS)])

    def learn(self, gate, items):
        n = self.s.orders
        slope, curve = np.zeros(n), self.curve.get(gate, 20 * np.eye(n))
        heft, ones = np.zeros(STEPS), np.zeros(STEPS)
        for x, bit, value in items:
            p = 1 / (1 + math.exp(-value))
            slope += (bit - p) * np.array(x)
            curve = curve + max(p * (1 - p), (bit - p) ** 2) * np.outer(x, x)
            low = int((value + 8) * 2)
            part = (value + 8) * 2 - low
            for at, share in ((low, 1 - part), (low + 1, part)):
                heft[at] += share
                ones[at] += share * bit
        self.curve[gate] = curve
        move = np.clip(np.linalg.solve(curve, slope), -1, 1)
        self.weights[gate] = np.rint((np.array(self.weights.get(gate, [0.4] * n)) + move) * VALUE_PARTS) / VALUE_PARTS
        was = np.array(self.refinement(gate))
        now = [r + (o / h - r) * h / (h + 200) if h else r for r, o, h in zip(was, ones, heft, strict=True)]
        self.refined[gate] = np.rint(np.array(now) * VALUE_PARTS) / VALUE_PARTS

    def score(self, text):
        total = 0.0
        for place, slots, bit in scalar_bits(text, self.s):
            gate, x = self.look(place, slots, [0, 1])
            value = self.mixed(gate, x)
            low = int((value + 8) * 2)
            part = (value + 8) * 2 - low
            refined = self.refinement(gate)
            p = (1 / (1 + math.exp(-value)) + refined[low] * (1 - part) + refined[low + 1] * part) / 2
            p = max(1 / 4096, min(1 - 1 / 4096, p))
            total += math.log10(p if bit else 1 - p)
        return total


def mixed_texts():
    rng = random.Random(9)
    copies = ["the same text again"] * 4
    return [sentence(rng, 12) for _ in range(24)] + ["", "Zahl 17 ü €"] + copies + [f"{n} 0123 {n * n}" for n in range(10)]


def test_scores_match_a_mixer_of_one_bit_at_a_time(spark):
    texts = mixed_texts()
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    model = ScalarMixer([t for t, h in zip(texts, held, strict=True) if not h], SMALL)
    assert len(model.weights) > 20  # gates that have learnt
    for row in score_texts(documents(spark, texts), held_out(5), settings=SMALL).collect():
        want = model.score(texts[row["doc_id"]])
        assert abs(row["score"] - want) < 1e-4 * max(1, abs(want))


def test_scores_do_not_depend_on_partitions(spark):
    texts = mixed_texts()
    frame = documents(spark, texts)
    found = []
    for n in (1, 3, 64):
        rows = score_texts(frame.repartition(n), held_out(5), settings=SMALL).collect()
        found.append(sorted((r["doc_id"], r["score"]) for r in rows))
    assert found[0] == found[1] == found[2]


def test_blocks_change_nothing(monkeypatch):
    rng = random.Random(8)
    texts = [sentence(rng, 60) for _ in range(5)]
    whole, mixer = grown(texts), learnt(texts[:2], grown(texts))
    monkeypatch.setattr(context_mixing, "GRAM_BLOCK", 64)
    blocks, other = grown(texts), learnt(texts[:2], whole)
    assert (whole.stretched == blocks.stretched).all() and (whole.level == blocks.level).all()
    assert np.allclose(mixer.weights, other.weights) and np.allclose(mixer.refined, other.refined)


def test_lots_wait_for_more_texts_while_they_hold_few_distinct_grams(monkeypatch):
    rng = random.Random(3)
    batch = pa.RecordBatch.from_pydict({"text": [sentence(rng, 200)], "side": pa.array([0], pa.int32())})
    once = len(distinct_grams(grams_of(batch["text"][0].as_py()))[0])
    monkeypatch.setattr(context_mixing, "LOT", 3 * once)
    lots = Lots(4)
    # Texts met again add to the counts only; before, they were handed on as if they were new.
    assert [x for _ in range(20) for x in lots.add(batch, "text")] == []
    [(side, grams, counts)] = lots.rest()
    assert side == 0 and len(grams) == once and counts.sum() == 20 * (len(batch["text"][0].as_py().encode()) + 1)


def test_a_slot_is_looked_up_once():
    zeros, ones = np.array([0, 0, 3, 900, 1]), np.array([0, 1, 0, 1, 7])
    table = pickle.loads(pickle.dumps(Table.of(zeros, ones)))
    value, level = table.at(np.array([[4, 0], [2, 3], [1, 1]]))
    assert (value == table.stretched[[[4, 0], [2, 3], [1, 1]]]).all() and (level == table.level[[[4, 0], [2, 3], [1, 1]]]).all()
