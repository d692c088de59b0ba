from __future__ import annotations

from pricetide.llm.chat_preferences import preference_pairs, swapped_replies


def show(role, text):
    return f"<|{role}|>\n{text}<|end|>\n"


def rendered(turns, at=0):
    text, mask = "", []
    for role, body in turns[at:]:
        piece = show(role or "", body or "")
        if role == "assistant":
            mask.append((len(text) + len(f"<|{role}|>\n"), len(text) + len(piece)))
        text += piece
    return text, mask


CASES = {
    1: ([("system", "s"), ("user", "u"), ("assistant", "good")], [("system", "s"), ("user", "u"), ("assistant", "bad😀")]),
    2: ([("user", "a"), ("assistant", "x"), ("user", "b"), ("assistant", "y")], [("user", "a"), ("assistant", "z"), ("user", "b")]),
    3: ([("user", "same"), ("assistant", "same")], [("user", "same"), ("assistant", "same")]),
    4: ([("user", "p")], [("assistant", "p")]),
    5: ([("user", None), (None, "t")], [("user", ""), ("", "t"), ("assistant", "")]),
    6: ([("user", "w" * 40_000), ("assistant", "v")], [("user", "w" * 40_000)]),
}


def table(spark, side):
    rows = [(k, n, r, t, "x", 1) for k, sides in CASES.items() for n, (r, t) in enumerate(sides[side])]
    rows.append((7 + side, 0, "user", "one side only", "x", 1))
    rows.append((None, 0, "user", "no id", "x", 1))
    return spark.createDataFrame(rows, "pair_id long, turn long, role string, text string, prompt string, place int")


def test_matches_brute_force(spark):
    found = {r["pair_id"]: r for r in preference_pairs(table(spark, 0), table(spark, 1)).collect()}
    assert set(found) == set(CASES)
    for key, (chosen, rejected) in CASES.items():
        clean = [[(r or "", t or "") for r, t in side] for side in (chosen, rejected)]
        at = next((i for i, (a, b) in enumerate(zip(*clean, strict=False)) if a != b), min(map(len, clean)))
        row = found[key]
        assert row["prompt"] == rendered(clean[0][:at])[0] and row["prompt_turns"] == at
        for name, side in zip(("chosen", "rejected"), clean, strict=True):
            text, mask = rendered(side, at)
            assert row[name] == text
            assert [tuple(s) for s in row[f"{name}_mask"]] == mask


def test_repeated_turn_numbers_and_empty_tables(spark):
    schema = "pair_id long, turn long, role string, text string"
    left = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a")], schema)
    right = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "b")], schema)
    row = preference_pairs(left, right).first()
    assert row["prompt"] == show("user", "a")
    assert row["chosen"] == show("user", "a") + show("user", "b") and row["rejected"] == show("user", "b")
    none = spark.createDataFrame([], schema)
    assert preference_pairs(none, right).collect() == []


def test_replies_are_swapped_between_mates(spark):
    rows = [
        (0, 0, "user", "q"), (0, 1, "assistant", "r0"), (0, 2, "user", "more"),
        (1, 0, "assistant", "r1"), (2, 0, "user", "alone"), (4, 0, "user", "q"), (4, 1, "assistant", "r4"),
        (None, 0, "assistant", "x"), (7, 1, None, None), (8, None, "user", "first"), (8, 0, "assistant", "r8"), (9, None, "assistant", "r9"),
    ]
    rows = [(*r, 3, "x", "y") for r in rows]
    shape = "conv_id long, turn long, role string, text string, pair_id long, reply string, place string"
    chosen, rejected = swapped_replies(spark.createDataFrame(rows, shape))
    found = {r["pair_id"]: (r["prompt"], r["chosen"], r["rejected"]) for r in preference_pairs(chosen, rejected).collect()}
    more, empty = show("user", "more"), show("", "")
    assert found == {
        0: (show("user", "q"), show("assistant", "r0") + more, show("assistant", "r1") + more),
        1: ("", show("assistant", "r1"), show("assistant", "r0")),
        2: (show("user", "alone"), "", ""),
        4: (show("user", "q"), show("assistant", "r4"), ""),
        7: (empty, "", ""),
        8: (show("user", "first"), show("assistant", "r8"), show("assistant", "r9")),
        9: ("", show("assistant", "r9"), show("assistant", "r8")),
    }


def test_every_conversation_of_no_replies_and_of_empty_tables(spark):
    shape = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (2, 0, "system", "c")]
    pairs = preference_pairs(*swapped_replies(spark.createDataFrame(rows, shape))).collect()
    assert sorted((r["pair_id"], r["prompt_turns"], r["chosen_turns"], r["rejected_turns"]) for r in pairs) == [(1, 2, 0, 0), (2, 1, 0, 0)]
    assert preference_pairs(*swapped_replies(spark.createDataFrame([], shape))).collect() == []
