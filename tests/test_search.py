from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from pricetide.operators import membership
from pricetide.operators.search import MemberIndex
from tests.conftest import rows

SHAPE = "index_code string, cm_product_id bigint, variant_key string, name string, set_name string, member_since date, member_until date, removed_at date"
NAMES = ["Charizard", "charm", "Pikachu ex", "Échar", None, "", "ab", "a%b_c", "日本語カード", "x" * 5000 + "needle"]


@pytest.fixture(scope="module")
def intervals(spark):
    data = []
    for i, name in enumerate(NAMES * 3):
        gone = date(2024, 3, 1) if i % 4 == 0 else None
        data.append((f"I{i % 2}", 100 + i % 7, ("foil", "nonfoil")[i % 2], name, ("Base Set 1", None, "Set 12")[i % 3],
                     date(2024, 1 + i % 2, 1), gone, gone))
    return spark.createDataFrame(data + data[:2], SHAPE)


@pytest.fixture(scope="module")
def index(spark, intervals, tmp_path_factory):
    # So few slots that entries share them.
    found = MemberIndex(spark, str(tmp_path_factory.mktemp("index")), buckets=2, parts=5)
    found.build(intervals)
    return found


@pytest.mark.parametrize("text", ["char", " CHAR ", "set 1", "x", "needle", "é", "échar", "日本語", "a%b", "none at all", "10", "103", "", "foil"])
@pytest.mark.parametrize("ever", [False, True])
def test_same_as_scanning_all_members(intervals, index, text, ever):
    day = F.lit(date(2024, 4, 1))
    got, want = (s(intervals, day, text, ever) for s in (index.search, membership.search))
    assert rows(got.fillna("-"), *got.columns[:6]) == rows(want.fillna("-"), *want.columns[:6])


def test_only_candidates_and_few_postings_are_read(index, intervals):
    found = index.candidates("needle")
    assert 0 < found.count() <= 4 < index.entries.read().count()
    assert index.candidates("none at all").count() == 0 and index.candidates("ne").count() == index.entries.read().count()
    versions = index.postings.versions()
    index.build(intervals)
    assert index.postings.versions() == versions


def test_empty_index(spark, intervals, tmp_path):
    index = MemberIndex(spark, str(tmp_path / "none"))
    index.build(intervals.limit(0))
    assert index.search(intervals.limit(0), F.lit(date(2024, 4, 1)), "char").count() == 0
