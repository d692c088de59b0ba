from __future__ import annotations

import gzip
import hashlib
import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from pricetide.operators import archive, merge, normalize
from pricetide.plans import daily
from pricetide.schemas import PRICES, PRODUCTS
from pricetide.session import cut_lineage
from pricetide.sinks import tables as sinks
from pricetide.sinks.versions import VersionedTable
from pricetide.sources import categories, snapshots, tables
from tests.conftest import rows

DAY = date(2026, 8, 12)
MAP = {"single": ["One Piece Single", " CARD "], "sealed": ["Booster"]}
DOC = "game_key string, run_date date, kind string, body string"


def documents(spark, *docs):
    return spark.createDataFrame([(g, d, k, json.dumps(b)) for g, d, k, b in docs], DOC)


def price_table(spark, body, game="onepiece"):
    docs = documents(spark, (game, DAY, "priceguide", body))
    records = snapshots.typed_records(snapshots.explode_records(docs))
    none = spark.createDataFrame([], "game_key string, cm_product_id bigint, product_kind string")
    return normalize.prices_table(records, none)


def test_envelopes(spark):
    item = {"idProduct": 1}
    docs = documents(
        spark,
        ("a", DAY, "priceguide", [item, 5, "x"]),
        ("b", DAY, "priceguide", {"products": [item], "data": [{"idProduct": 2}]}),
        ("c", DAY, "priceguide", {"priceGuide": {"no": 1}, "priceGuides": [item]}),
        ("d", DAY, "priceguide", {"items": [item]}),
        ("e", DAY, "priceguide", {"data": "text"}),
    )
    records = snapshots.typed_records(snapshots.explode_records(docs))
    assert rows(records, "game_key", "cm_product_id") == [("a", 1), ("b", 2), ("c", 1)]
    assert rows(snapshots.bad_envelopes(docs), "game_key") == [("d",), ("e",)]


def test_price_families(spark):
    body = {
        "priceGuides": [
            {"idProduct": 1, "avg": 2, "low": 1.5, "avg-foil": 4.0, "low-foil": 3.0},
            {"idProduct": 2, "avg": None, "low": 7.0},
            {"idProduct": 3, "avg": None, "low": None, "avg-foil": 9.0},
            {"idProduct": 4, "avg": 0, "low": None},
            {"idProduct": 5},
        ]
    }
    got = rows(price_table(spark, body), "cm_product_id", "variant_key")
    assert got == [(1, "foil"), (1, "nonfoil"), (2, "nonfoil"), (3, "foil"), (4, "nonfoil")]


def test_holo_game_maps_to_foil(spark):
    body = {"priceGuides": [{"idProduct": 1, "avg": 1.0, "low": 0.5, "avg-holo": 4.0, "avg-foil": 8.0}]}
    table = price_table(spark, body, "pokemon")
    assert rows(table.filter("variant_key = 'foil'"), "price_avg") == [(4.0,)]


def test_integer_and_decimal_prices_are_doubles(spark):
    guide = [{"idProduct": i, "avg": 1, "low": 1} for i in range(101)] + [{"idProduct": 200, "avg": 2.5, "low": 0.1}]
    table = price_table(spark, {"priceGuides": guide})
    assert dict(table.dtypes)["price_avg"] == "double"
    assert table.agg(F.sum("price_avg")).first()[0] == pytest.approx(103.5)


def test_gzip_files_are_read_whole(spark, tmp_path):
    path = tmp_path / "cardmarket/priceguide/magic/2026/08"
    path.mkdir(parents=True)
    (path / "2026-08-12.json.gz").write_bytes(gzip.compress(json.dumps({"priceGuides": [{"idProduct": 7, "name": "é"}]}).encode()))
    docs = snapshots.read_documents(spark, str(tmp_path / "cardmarket/*/*/*/*"))
    assert rows(docs, "kind", "game_key", "run_date") == [("priceguide", "magic", DAY)]
    records = snapshots.typed_records(snapshots.explode_records(docs))
    assert rows(records, "cm_product_id", "name") == [(7, "é")]


def test_categories(spark, tmp_path):
    frame = categories.category_frame(spark, MAP)
    assert rows(frame, "label", "kind") == [("booster", "sealed"), ("card", "single"), ("one piece single", "single")]
    with pytest.raises(ValueError):
        categories.category_frame(spark, {"misc": ["x"]})
    (tmp_path / "map.json").write_text(json.dumps({"single": ["Card"], "sealed": ["card "]}))
    with pytest.raises(ValueError, match="card"):
        categories.load_category_map(spark, tmp_path / "map.json")


def catalogue_doc(products, day=DAY, game="onepiece"):
    return (game, day, "catalogue", {"version": 1, "products": products})


def test_catalogue(spark):
    docs = documents(
        spark,
        catalogue_doc(
            [
                {"idProduct": 1, "name": "A", "categoryName": " one piece SINGLE ", "idExpansion": 5, "dateAdded": "0000-00-00 00:00:00"},
                {"idProduct": 2, "categoryName": "Strange", "idExpansion": 5, "setName": "Romance Dawn"},
                {"idProduct": 3, "name": "C"},
            ]
        ),
    )
    batch = daily.normalize_documents(docs, categories.category_frame(spark, MAP))
    assert rows(batch.products, "cm_product_id", "name", "product_kind", "source_date_added") == [
        (1, "A", "single", None),
        (2, "Product 2", "other", None),
        (3, "C", "other", None),
    ]
    assert rows(batch.sets, "cm_expansion_id", "name") == [(5, "Romance Dawn")]
    quality = batch.quality.first()
    assert (quality.status, quality.unknown_products) == ("fail", 2)
    assert rows(batch.unknown_categories, "category") == [("(missing)",), ("Strange",)]


def test_merge_keeps_absent_rows_and_widens_dates(spark):
    def product(pid, name, day, kind="single"):
        return (f"p{pid}", "g", pid, None, None, None, name, kind, "c", None, day, day)

    old = spark.createDataFrame([product(1, "old", date(2026, 8, 1)), product(2, "gone", date(2026, 8, 1))], PRODUCTS)
    new = spark.createDataFrame([product(1, None, DAY), product(3, "new", DAY)], PRODUCTS)
    got = rows(merge.merge_catalogue(old, new, "stable_product_id"), "stable_product_id", "name", "first_seen", "last_seen")
    assert got == [
        ("p1", None, date(2026, 8, 1), DAY),
        ("p2", "gone", date(2026, 8, 1), date(2026, 8, 1)),
        ("p3", "new", DAY, DAY),
    ]


def day_docs(n=1000, day=DAY, foil=1, category="One Piece Single", price=1.0):
    guide = [{"idProduct": i, "idCategory": 1, "avg": price, "low": 0.5} for i in range(n)]
    for item in guide[:foil]:
        item["avg-foil"] = 3.0
    products = [{"idProduct": i, "name": f"N{i}", "categoryName": category, "idExpansion": i % 3} for i in range(n)]
    return [("onepiece", day, "priceguide", {"priceGuides": guide}), catalogue_doc(products, day)]


def entries(docs):
    """Manifest entries that fit the documents."""
    body = F.col("body")
    return docs.select(
        F.col("run_date").cast("string").alias("run_date"),
        F.lit(1).alias("schema_version"),
        "game_key",
        "kind",
        archive.snapshot_key(F.col("kind"), F.col("game_key"), F.col("run_date")).alias("key"),
        F.sha2(body, 256).alias("sha256"),
        F.octet_length(body).cast("bigint").alias("size"),
        F.lit("2026-08-14T00:00:00Z").alias("fetched_at"),
    )


def run_day(spark, docs, cats, root):
    return daily.run_normalize(spark, daily.landed_bodies(docs), cats, root, entries(docs), min_records=1)


def test_daily_run_is_repeatable(spark, tmp_path):
    cats = categories.category_frame(spark, MAP)
    root = str(tmp_path / "tables")
    docs = documents(spark, *day_docs())
    notes = run_day(spark, docs, cats, root)
    assert rows(notes, "status", "catalogue_products", "catalogue_variants", "price_rows") == [("ok", 1000, 1001, 1001)]

    def state():
        return {
            name: sorted(map(str, sinks.read_stored(spark, f"{root}/{name}").collect()))
            for name in ("products", "sets", "variants", "prices")
        }

    first = state()
    run_day(spark, docs, cats, root)
    assert state() == first

    # Another price on the same day replaces it; a late day goes to its own month.
    late = date(2026, 7, 30)
    more = documents(spark, *day_docs(price=2.0), *day_docs(n=10, day=late, foil=0))
    run_day(spark, more, cats, root)
    stored = tables.read_prices(spark, f"{root}/prices", DAY)
    assert [f.name for f in PRICES.fields] == stored.columns
    assert rows(stored.groupBy("value_date").count(), "value_date", "count") == [(late, 10), (DAY, 1001)]
    assert rows(stored.filter("cm_product_id = 5 and value_date = '2026-08-12'"), "price_avg") == [(2.0,)]
    assert tables.read_prices(spark, f"{root}/prices", late).count() == 10
    seen = sinks.read_stored(spark, f"{root}/products").filter("cm_product_id = 5")
    assert rows(seen, "first_seen", "last_seen") == [(late, DAY)]


def test_quality_gate_withholds_only_the_completion(spark, tmp_path):
    cats = categories.category_frame(spark, MAP)
    root = str(tmp_path / "tables")
    notes = run_day(spark, documents(spark, *day_docs(n=20, category="Strange")), cats, root)
    assert rows(notes, "status", "classification_coverage") == [("fail", 0.0)]
    assert tables.read_prices(spark, f"{root}/prices", DAY).count() == 21
    assert sinks.read_stored(spark, f"{root}/products").count() == 20
    assert sinks.read_stored(spark, f"{root}/completions").count() == 0
    assert rows(sinks.read_stored(spark, f"{root}/unknown_categories"), "category") == [("Strange",)]
    # A replay that knows the label completes the day, and the label is no longer listed.
    wider = categories.category_frame(spark, {**MAP, "other": ["strange"]})
    notes = run_day(spark, documents(spark, *day_docs(n=20, category="Strange")), wider, root)
    assert rows(notes, "status") == [("ok",)]
    assert sinks.read_stored(spark, f"{root}/unknown_categories").count() == 0
    done = sinks.read_stored(spark, f"{root}/completions").first()
    assert len(done["catalogue_sha256"]) == len(done["priceguide_sha256"]) == 64
    # The completion lists every output that holds the day, with the rows it has.
    assert [(o["output"], o["rows"]) for o in done["outputs"]] == [
        ("prices/game_key=onepiece/month=2026-08", 21),
        ("products/game_key=onepiece", 20),
        ("sets/game_key=onepiece", 3),
        ("variants/game_key=onepiece", 21),
    ]
    assert len(notes.first()["completion_fingerprint"]) == 64


def test_a_run_that_dies_can_be_repeated(spark, tmp_path, monkeypatch):
    cats = categories.category_frame(spark, MAP)
    root = str(tmp_path / "tables")
    run_day(spark, documents(spark, *day_docs(n=5)), cats, root)
    before = rows(sinks.read_stored(spark, f"{root}/prices"), "cm_product_id", "price_avg")
    commit = VersionedTable._commit

    def dies(self, *args):
        if self.root.endswith("/prices"):
            raise RuntimeError("lost")
        return commit(self, *args)

    monkeypatch.setattr(VersionedTable, "_commit", dies)
    again = documents(spark, *day_docs(n=5, price=7.0))
    with pytest.raises(RuntimeError, match="lost"):
        run_day(spark, again, cats, root)
    assert rows(sinks.read_stored(spark, f"{root}/prices"), "cm_product_id", "price_avg") == before
    monkeypatch.undo()
    run_day(spark, again, cats, root)
    prices = sinks.read_stored(spark, f"{root}/prices").filter("variant_key = 'nonfoil'")
    assert rows(prices.select("price_avg").distinct(), "price_avg") == [(7.0,)]


def archive_of(spark, root, *docs):
    """Write documents and their manifests as files; returns the archive's folder."""
    by_day = {}
    for game, day, kind, body in docs:
        text = json.dumps(body) + "\n"
        key = f"cardmarket/{kind}/{game}/{day:%Y}/{day:%m}/{day}.json.gz"
        (root / key).parent.mkdir(parents=True, exist_ok=True)
        (root / key).write_bytes(gzip.compress(text.encode()))
        entry = {"game": game, "kind": kind, "key": key, "sha256_uncompressed": hashlib.sha256(text.encode()).hexdigest()}
        by_day.setdefault(day, []).append(entry | {"size_uncompressed": len(text.encode()), "fetched_at": f"{day}T05:00:00Z"})
    (root / "manifests").mkdir(exist_ok=True)
    for day, files in by_day.items():
        manifest = {"run_date": str(day), "schema_version": 1, "files": files}
        (root / "manifests" / f"{day}.json").write_text(json.dumps(manifest))
    return str(root)


def test_backfill_stream_goes_on_where_it_died(spark, tmp_path, monkeypatch):
    cats = categories.category_frame(spark, MAP)
    days = [date(2026, 8, d) for d in (10, 11, 12, 13)]
    docs = [d for day in days for d in day_docs(n=4, day=day, category="Strange" if day.day == 12 else "One Piece Single")]
    root, first, last = archive_of(spark, tmp_path / "a", *docs), days[0], days[-1]

    def run(out, per_batch):
        query = daily.start_backfill(spark, root, cats, str(tmp_path / out), str(tmp_path / f"{out}-ck"), first, last, per_batch, 1)
        query.awaitTermination()

    run("whole", 4)
    calls = []
    original = daily.run_normalize

    def dies(*args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return original(*args)

    monkeypatch.setattr(daily, "run_normalize", dies)
    with pytest.raises(Exception, match="lost"):
        run("parts", 2)
    monkeypatch.undo()
    run("parts")
    for name in ("products", "prices", "unknown_categories", "runs"):
        one, two = (sinks.read_stored(spark, str(tmp_path / out / name)) for out in ("whole", "parts"))
        assert rows(one.drop("completion_fingerprint"), *one.drop("completion_fingerprint").columns) == rows(
            two, *one.drop("completion_fingerprint").columns
        )
    status = daily.backfill_status(spark, str(tmp_path / "parts"), first, last)
    assert [r[1] for r in rows(status, "run_date", "status")] == ["pass", "pass", "fail", "pass"]


def test_manifest_is_checked_first(spark, tmp_path):
    cats = categories.category_frame(spark, MAP)
    root = str(tmp_path / "tables")
    docs = documents(spark, *day_docs(n=5), *day_docs(n=5, day=date(2026, 8, 13)))
    wrong = F.when(F.dayofmonth("run_date") == 12, F.col("sha256")).otherwise(F.sha2(F.lit("x"), 256))
    files = entries(docs).withColumn("sha256", wrong)
    notes = daily.run_normalize(spark, daily.landed_bodies(docs), cats, root, files, min_records=1)
    assert rows(notes, "run_date", "status") == [(DAY, "ok"), (date(2026, 8, 13), "rejected")]
    assert rows(sinks.read_stored(spark, f"{root}/prices").select("value_date").distinct(), "value_date") == [(DAY,)]


def test_labels_of_any_white_space_and_case(spark):
    cats = categories.category_frame(spark, {"single": ["Straße Karte"]})
    labels = ["Straße Karte\t", "\u00a0STRASSE KARTE\n", " strasse karte ", "other"]
    found = spark.createDataFrame([(x,) for x in labels], "raw_category string")
    assert rows(normalize.catalogue_records(found, cats), "product_kind") == [("other",), ("single",), ("single",), ("single",)]


def test_products_listed_twice_do_not_double_prices(spark):
    prices = spark.createDataFrame([("g", 1, DAY)], "game_key string, cm_product_id bigint, run_date date")
    kinds = [("g", 1, DAY, "single"), ("g", 1, DAY, "other"), ("g", 1, date(2026, 8, 1), "sealed")]
    products = spark.createDataFrame(kinds, "game_key string, cm_product_id bigint, run_date date, product_kind string")
    assert rows(normalize.with_product_kind(prices, products), "product_kind") == [("single",)]


def test_duplicate_ids_spoil_only_their_day(spark, tmp_path):
    cats = categories.category_frame(spark, MAP)
    bad = day_docs(n=5, day=date(2026, 8, 11))
    bad[0][3]["priceGuides"].append({"idProduct": 1, "avg": 9.0})
    notes = run_day(spark, documents(spark, *bad, *day_docs(n=5)), cats, str(tmp_path / "t"))
    assert rows(notes, "run_date", "status") == [(date(2026, 8, 11), "invalid"), (DAY, "ok")]


def test_backfill_reports_every_day(spark, tmp_path):
    cats = categories.category_frame(spark, MAP)
    docs = documents(spark, *day_docs(n=5), *day_docs(n=5, day=date(2026, 8, 14), category="Strange"))
    landed = daily.landed_bodies(docs)
    status = daily.backfill(spark, landed, entries(docs), cats, str(tmp_path / "t"), DAY, date(2026, 8, 14), 1)
    assert rows(status, "run_date", "status") == [
        (DAY, "pass"),
        (date(2026, 8, 13), "fail"),
        (date(2026, 8, 14), "fail"),
    ]
    with pytest.raises(ValueError):
        daily.backfill(spark, landed, entries(docs), cats, str(tmp_path / "t"), DAY, date(2026, 8, 1))


def test_source_check(spark):
    ids = "game_key string, run_date date, cm_product_id bigint"
    prices = spark.createDataFrame([("g", DAY, 1)], ids)
    products = spark.createDataFrame([("g", DAY, 1), ("g", DAY, 2)], ids)
    r = normalize.source_check(prices, products).first()
    assert (r.matched_price_records, r.catalogue_coverage, r.status) == (1, 1.0, "pass")
    twice = prices.unionByName(prices)
    assert normalize.source_check(twice, products).first().status == "fail"


def test_missing_catalogue(spark, tmp_path):
    assert tables.read_catalogue(spark, str(tmp_path / "none"), PRODUCTS).count() == 0
    with pytest.raises(RuntimeError):
        tables.read_catalogue(spark, str(tmp_path / "none"), PRODUCTS, required=True)


def test_only_the_wanted_members_of_records_are_parsed(spark):
    rows = spark.createDataFrame([('{"idProduct": 7, "average": 2.5, "name": "n", "foilAvg": 3}',)], "item string")
    typed = snapshots.typed_records(rows, ["cm_product_id", "base_avg"])
    assert [tuple(r) for r in typed.collect()] == [(7, 2.5)]
    assert [f.name for f in snapshots._record_schema(["base_avg"]).fields] == ["average", "avg", "avgPrice", "price_avg"]


def test_an_envelope_holds_its_records_once(spark):
    from pyspark.sql import functions as F

    from pricetide.queries import views

    keys = spark.range(12).withColumnRenamed("id", "k")
    body = views._enveloped(F.col("k"), F.array(F.concat(F.lit('{"id": '), F.reverse(F.col("k").cast("string")), F.lit("}"))))
    frame = keys.select("k", body.alias("body"))
    assert frame._jdf.queryExecution().analyzed().toString().count("reverse") == 1
    bodies = {r["k"]: r["body"] for r in frame.collect()}
    assert bodies[0] == '["stray", {"id": 0}]' and bodies[3] == '{"version": 1, "createdAt": "2001-01-01T00:00:00+0000", "priceGuide": [{"id": 3}]}'


def test_prices_of_a_run_are_worked_out_once(spark, tmp_path, monkeypatch):
    worked_out = spark.sparkContext.accumulator(0)
    original = normalize.prices_table

    def counted(records, products):
        prices = original(records, products)

        def run(batches):
            for batch in batches:
                worked_out.add(batch.num_rows)
                yield batch

        return prices.mapInArrow(run, prices.schema)

    monkeypatch.setattr(normalize, "prices_table", counted)
    root = str(tmp_path / "tables")
    run_day(spark, documents(spark, *day_docs(n=5)), categories.category_frame(spark, MAP), root)
    assert worked_out.value == sinks.read_stored(spark, f"{root}/prices").count()


def test_records_of_a_run_are_classified_once(spark, tmp_path, monkeypatch):
    classified = spark.sparkContext.accumulator(0)
    original = normalize.classify

    def counted(records, known):
        out = original(records, known)

        def run(batches):
            for batch in batches:
                classified.add(batch.num_rows)
                yield batch

        return out.mapInArrow(run, out.schema)

    monkeypatch.setattr(normalize, "classify", counted)
    notes = run_day(spark, documents(spark, *day_docs(n=5)), categories.category_frame(spark, MAP), str(tmp_path / "t"))
    assert rows(notes, "status", "catalogue_products") == [("ok", 5)]
    assert classified.value == 5


def test_records_of_another_kind_count_by_their_ids(spark, tmp_path):
    cats = categories.category_frame(spark, MAP)
    extra = {"version": 1, "createdAt": "2026-08-12", "products": [{"idProduct": 1}]}
    twice = extra | {"products": [{"idProduct": 1}, {"idProduct": 1, "avg": 2}]}
    docs = [d for day in (10, 11) for d in day_docs(n=5, day=date(2026, 8, day))]
    docs += [("onepiece", date(2026, 8, 10), "extra", extra), ("onepiece", date(2026, 8, 11), "extra", twice)]
    notes = run_day(spark, documents(spark, *docs), cats, str(tmp_path / "t"))
    assert rows(notes, "run_date", "status") == [(date(2026, 8, 10), "ok"), (date(2026, 8, 11), "invalid")]


def test_prices_are_merged_by_the_shuffle_that_sorts_them(spark):
    shape = "game_key string, cm_product_id bigint, variant_key string, value_date date, price_avg double, month string"
    old = spark.createDataFrame([("g", i, "foil", DAY, 1.0, "2026-08") for i in range(6)], shape)
    new = spark.createDataFrame([("g", i, "foil", DAY, None, "2026-08") for i in range(3, 9)], shape)
    order = ["game_key", "month", "cm_product_id", "variant_key", "value_date"]
    merged = merge.merge_prices(old, new, order)
    assert rows(merged, *merge.PRICE_KEY, "price_avg") == rows(merge.merge_prices(old, new), *merge.PRICE_KEY, "price_avg")
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Exchange rangepartitioning") == 1


def test_small_sides_are_sent_to_tasks(spark):
    days = cut_lineage(spark.createDataFrame([("1", DAY)], "game_key string, run_date date"))
    many = spark.range(3).select(F.col("id").cast("string").alias("game_key"), F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("run_date"))

    def plan(most):
        return many.join(daily._sent(days, most), daily.DAY, "left_semi")._jdf.queryExecution().executedPlan().toString()

    assert "BroadcastHashJoin" in plan(1) and "BroadcastHashJoin" not in plan(0)
