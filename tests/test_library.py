from datetime import date, timedelta

import pytest

from tidemark.operators import joins, sequences
from tidemark.plans import build, features, folds
from tidemark.plans.folds import Fold, check
from tidemark.sources import files, footers
from tidemark.streaming import metrics


def test_fold_contract():
    good = [Fold(1, date(2020, 1, 1)), Fold(2, date(2020, 2, 1))]
    check(good, Fold(3, date(2020, 3, 1)))
    with pytest.raises(ValueError, match="overlap"):
        check([good[0], Fold(2, date(2020, 1, 10))], Fold(3, date(2020, 3, 1)))
    with pytest.raises(ValueError, match="increase"):
        check(good[::-1] and [Fold(1, date(2020, 2, 1)), Fold(2, date(2020, 1, 1))], Fold(3, date(2020, 3, 1)))
    with pytest.raises(ValueError, match="numbers"):
        check([Fold(2, date(2020, 1, 1))], Fold(3, date(2020, 3, 1)))


def test_many_to_one_rejects_double_keys(spark):
    """Within the query itself, whether the key is met or not."""
    dim = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    base = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    for rows in (base, base.where("k = 2")):
        with pytest.raises(Exception, match="not unique"):
            joins.many_to_one(rows, dim, ["k"]).agg({"v": "count"}).collect()
        with pytest.raises(Exception, match="not unique"):
            joins.many_to_one(rows, dim, ["k"], matched="met").groupBy("met").count().collect()
    out = joins.many_to_one(base, dim.where("v <> 'b'"), ["k"], matched="met")
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [(1, "a", True), (2, "c", True), (2, "c", True), (None, None, False)]))
    with pytest.raises(Exception, match="not unique"):
        joins.many_to_one(base, dim.where("k is null").union(dim.where("k is null")), ["k"]).collect()


def test_publish(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert files.publish(df, str(tmp_path / "t"))["rows"] == 2
    assert spark.read.text(str(tmp_path / "t.manifest")).count() > 0
    with pytest.raises(ValueError, match="nothing"):
        files.publish(df.where("false"), str(tmp_path / "e"))
    with pytest.raises(Exception, match="(?i)exists"):
        files.publish(df, str(tmp_path / "t"))


def test_streaming_counts_equal_batch(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    run = metrics.counts(stream.withColumn("ts", stream["ts"].cast("timestamp"))).writeStream.format("memory").queryName("counted").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("counted").agg({"n": "sum"}).first()[0] == source.count()


def test_failed_overwrite_leaves_the_table_as_it_was(spark, tmp_path):
    df, path = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string"), str(tmp_path / "t")
    manifest = files.publish(df, path)

    def refuse(back):
        raise ValueError("refused")

    for bad, more in ((df.where("false"), {}), (df, {"check": refuse})):
        with pytest.raises(ValueError, match="nothing|refused"):
            files.publish(bad, path, overwrite=True, **more)
        assert spark.read.parquet(path).count() == 2
        assert files.read_json(spark, f"{path}.manifest", {"rows": 2}) == manifest
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["t", "t.manifest"]
    assert files.publish(df.limit(1), path, overwrite=True)["rows"] == 1
    assert spark.read.parquet(path).count() == 1
    with pytest.raises(ValueError, match="required"):
        files.read_json(spark, f"{path}.manifest", {"rows": 2})


def test_csv_with_a_declared_schema(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,d,v\n1,2020-01-31,x\n2,,y\n")
    path = str(tmp_path / "a.csv")
    rows = files.read_csv(spark, path, "k int, d date, v string", ["d", "k"]).collect()
    assert [tuple(r) for r in rows] == [(date(2020, 1, 31), 1), (None, 2)]
    assert [r["column"] for r in files.header(spark, path).collect()] == ["k", "d", "v"]
    (tmp_path / "b.csv").write_text("k,d\nx,2020-01-31\n")
    with pytest.raises(Exception, match="(?i)malformed|cannot|parse"):
        files.read_csv(spark, str(tmp_path / "b.csv"), "k int, d date").collect()
    with pytest.raises(Exception, match="(?i)header|schema"):
        files.read_csv(spark, path, "k int, other date, v string").collect()
    assert files.preview(files.read_csv(spark, path, "k int, d date, v string"), 1, ["k"]).first()["k"] == 1


def test_inventory_and_expected_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.bin").write_bytes(b"")
    assert {r["name"]: r["bytes"] for r in files.inventory(spark, str(tmp_path)).collect()} == {"a.bin": 3, "b.bin": 0}
    files.require_files(spark, str(tmp_path), ["a.bin", "in/b.bin"])
    with pytest.raises(FileNotFoundError, match="c.bin"):
        files.require_files(spark, str(tmp_path), ["a.bin", "c.bin"])


def test_schema_footers_and_reconciliation(spark, tmp_path):
    path = "/root/testdata/sf0.001/nation.parquet"
    df = spark.read.parquet(path)
    assert [(r["position"], r["column"], r["type"]) for r in files.schema_table(df).collect()] == [(0, "n_nationkey", "int"), (1, "n_name", "string"), (2, "n_regionkey", "int")]
    facts = footers.facts(spark, path)
    assert (facts["rows"], facts["columns"], facts["row_groups"]) == (25, 3, 1)
    assert files.reconciled(df, facts["rows"]).count() == 25
    with pytest.raises(ValueError, match="25 rows"):
        files.reconciled(df, 24)


def test_evidence_is_aggregates(spark, tmp_path):
    path = str(tmp_path / "e.json")
    document = {"b": {"day": date(2020, 1, 2)}, "a": "Öl"}
    assert files.write_json(spark, document, path) == {"a": "Öl", "b": {"day": "2020-01-02"}}
    with pytest.raises(FileExistsError):
        files.write_json(spark, document, path)
    with pytest.raises(ValueError, match="aggregates"):
        files.write_json(spark, {"rows": {"all": [list(range(101))]}}, path, overwrite=True, evidence=True)
    assert files.read_json(spark, path, {"a": "Öl"})["a"] == "Öl"


def base_rows(days=60, stores=(1, 2), items=(10, 11, 12), first=date(2020, 1, 1)):
    out = []
    for k in range(days):
        d = first + timedelta(days=k)
        for s in stores:
            for i in items:
                kind = "A" if k < 35 else "B"
                out.append((d, s, i, float(k + s * 100 + i), k % 2 == 0, "F", 7, 1, "C", "S", kind, 3, 50.0 + k, 40.0 + k, k == 40, "Holiday" if k == 40 else None, None, "earthquake day" if k == 40 else None, None, None))
    return out


BASE = "date date, store_nbr int, item_nbr int, unit_sales double, onpromotion boolean, family string, class int, perishable int, city string, state string, store_type string, cluster int, transactions double, dcoilwtico double, is_holiday boolean, holiday_type string, holiday_locale string, holiday_description string, holiday_transferred boolean, holiday_event_count int"
ORIGIN = date(2020, 2, 4)  # day 34


def test_model_table_keeps_its_contract(spark):
    df = spark.createDataFrame(base_rows(), BASE)
    table = features.model_table(df, [ORIGIN])
    facts = features.check_contract(table)
    assert (len(table.columns), facts["rows"], facts["n_forecast_horizon"]) == (43, 16 * 6, 16)
    row = table.where("store_nbr = 1 and item_nbr = 10 and forecast_horizon = 16").first()
    assert (row["sales_lag_1"], row["sales_lag_28"], row["sales_rolling_mean_7"], row["store_type"]) == (143.0, 116.0, 140.0, "A")
    assert (row["transactions_at_origin"], row["transactions_mean_7d"], row["oil_pct_change_1d"]) == (84.0, 81.0, pytest.approx(74 / 73 - 1))
    assert row["onpromotion"] is None and row["is_holiday"] is None
    # nothing after the origin reaches a feature
    later = df.withColumn("unit_sales", df["unit_sales"] * (df["date"] <= ORIGIN).cast("int"))
    drop = features.TARGET
    assert sorted(map(tuple, features.model_table(later, [ORIGIN]).drop(drop).collect())) == sorted(map(tuple, table.drop(drop).collect()))
    assert features.model_table(df, [date(2030, 1, 1)]).columns == features.TRAINING


def test_model_table_of_known_ahead_columns(spark):
    df = spark.createDataFrame(base_rows(), BASE)
    rows = features.model_table(df, [ORIGIN], planned_promotion=True, published_holidays=True).where("store_nbr = 1 and item_nbr = 10").collect()
    assert {r["forecast_horizon"]: (r["onpromotion"], r["is_holiday"]) for r in rows}[6] == (True, None)
    assert {r["forecast_horizon"]: (r["onpromotion"], r["is_holiday"]) for r in rows}[7] == (False, False)


def test_model_table_bounds_items(spark):
    rows = [r for r in base_rows() if not (r[2] == 10 and r[0] > ORIGIN)]
    table = features.model_table(spark.createDataFrame(rows, BASE), [ORIGIN], max_items=1)
    assert {r["item_nbr"] for r in table.collect()} == {11}


@pytest.mark.parametrize(
    ("change", "message"),
    [
        (lambda rows: [r for r in rows if not (r[2] == 12 and r[0] <= ORIGIN)], "without static attributes"),
        (lambda rows: [(*r[:5], None, *r[6:]) if r[2] == 12 else r for r in rows], "static attributes are null"),
        (lambda rows: [*rows, rows[240]], "repeated grain"),
        (lambda rows: [(*r[:12], 1.0 if r[2] == 12 else r[12], *r[13:]) for r in rows], "transactions is not the same"),
        (lambda rows: [(*r[:13], None if r[2] == 12 else r[13], *r[14:]) for r in rows], "dcoilwtico is not the same"),
        (lambda rows: [(r[0], r[1] * 40_000, *r[2:]) for r in rows], "does not fit smallint"),
    ],
)
def test_model_table_errors(spark, change, message):
    with pytest.raises(Exception, match=message):
        features.model_table(spark.createDataFrame(change(base_rows()), BASE), [ORIGIN]).collect()


def test_series_that_first_appears_after_the_origin(spark):
    rows = [(ORIGIN + timedelta(days=k), 1, i, 1.0) for k in (-3, 2) for i in (1, 2) if (k, i) != (-3, 2)]
    df = spark.createDataFrame(rows, "day date, store int, item int, sales double")
    with pytest.raises(Exception, match="not known at the origin"):
        features.sales_features(df, [ORIGIN]).collect()
    assert [r["item"] for r in features.sales_features(df, [ORIGIN], unknown="drop").collect()] == [1]


def test_static_attributes_are_those_at_the_origin(spark):
    rows = [(ORIGIN + timedelta(days=k), 1, 1, 1.0, f"s{k}") for k in (-3, -1, 2)]
    df = spark.createDataFrame(rows, "day date, store int, item int, sales double, kind string")
    assert features.sales_features(df, [ORIGIN], static=["kind"]).first()["kind"] == "s-1"


def test_build(spark, tmp_path):
    source = str(tmp_path / "base")
    spark.createDataFrame(base_rows(), BASE).repartition(2).write.parquet(source)
    config = build.Build(source, str(tmp_path / "out"), str(tmp_path / "out.json"), (ORIGIN,), ((1,), (2,)), max_items=2)
    document = build.run(spark, config)
    assert document["expected_rows"] == document["output"]["rows"] == 16 * 4
    assert document["source"]["rows"] == 360
    assert features.check_contract(spark.read.parquet(config.output))["n_item_nbr"] == 2
    with pytest.raises(FileExistsError):
        build.run(spark, config)


def test_build_of_many_origins_and_files(spark, tmp_path, monkeypatch):
    """150 origins and source files end with a whole document; a document that fails leaves everything as it was."""
    source = str(tmp_path / "base")
    spark.createDataFrame(base_rows(200, (1,), (10,)), BASE).repartition(150).write.parquet(source)
    origins = tuple(date(2020, 2, 1) + timedelta(days=k) for k in range(150))
    config = build.Build(source, str(tmp_path / "out"), str(tmp_path / "out.json"), origins, ((1,),), overwrite=True)
    monkeypatch.setattr(build.features, "model_table", lambda base, *a: base.limit(3))
    monkeypatch.setattr(build.features, "check_contract", lambda back: {"rows": 3})
    monkeypatch.setattr(build, "targets", lambda base, config: 3)
    document = build.run(spark, config)
    assert (len(document["origins"]), document["source"]["files"]) == (150, len(list((tmp_path / "base").glob("part-*"))))
    old = [str(p) for p in sorted((tmp_path / "out").iterdir())]
    place = files._hadoop
    calls = []

    def refuse(spark, path):  # the last move fails
        calls.append(path)
        if path == config.manifest and len([c for c in calls if c == path]) > 1:
            raise OSError("no room")
        return place(spark, path)

    with monkeypatch.context() as m:
        m.setattr(files, "_hadoop", refuse)
        with pytest.raises(OSError, match="no room"):
            files._place(spark, {files._staged_json(spark, {"a": 1}, str(tmp_path / "out"))[0]: str(tmp_path / "out"), files._staged_json(spark, {"a": 1}, config.manifest)[0]: config.manifest} | {"x": config.manifest})
    assert [str(p) for p in sorted((tmp_path / "out").iterdir())] == old
    assert files.read_json(spark, config.manifest) == document


def test_build_goes_on_where_it_broke_off(spark, tmp_path, monkeypatch):
    source, work = str(tmp_path / "base"), str(tmp_path / "work")
    spark.createDataFrame(base_rows(), BASE).repartition(2).write.parquet(source)
    origins = (ORIGIN, ORIGIN + timedelta(days=3))
    whole = build.Build(source, str(tmp_path / "one"), str(tmp_path / "one.json"), origins, ((1,), (2,)))
    build.run(spark, whole)
    config = build.Build(source, str(tmp_path / "out"), str(tmp_path / "out.json"), origins, ((1,), (2,)))
    plain, calls = features.model_table, []

    def breaks(base, found, *rest):
        calls.append((sorted(r["store_nbr"] for r in base.select("store_nbr").distinct().collect()), list(found)))
        if len(calls) == 2:
            raise RuntimeError("killed")
        return plain(base, found, *rest)

    monkeypatch.setattr(build.features, "model_table", breaks)
    with pytest.raises(RuntimeError, match="killed"):
        build.run_in_cells(spark, config, work)
    assert build.finished(spark, work).count() == 2 and not files.exists(spark, config.output)
    # an attempt that moved files without reaching the ledger leaves nothing
    (tmp_path / "work" / "table" / "batch1-part-x.parquet").write_bytes(b"half a file")
    document = build.run_in_cells(spark, config, work)
    assert calls == [([1], list(origins)), ([2], list(origins)), ([2], list(origins))]
    assert (document["cells"], document["rows"]) == (4, 2 * 16 * 6 - 0)
    rows = lambda at: sorted(map(str, spark.read.parquet(at).collect()))
    assert rows(config.output) == rows(whole.output)
    other = build.Build(source, str(tmp_path / "new"), str(tmp_path / "new.json"), origins, ((1,), (2,)), max_items=1)
    with pytest.raises(ValueError, match="other settings"):
        build.run_in_cells(spark, other, work)


def test_comparison_in_order(spark, tmp_path):
    rows = [(i, i % 7 if i % 5 else None, f"v{i % 11}") for i in range(1000)]
    write = lambda part, name: spark.createDataFrame(part, "a long, b long, c string").coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    def table(name, rows, cuts):
        at = tmp_path / name
        at.mkdir()
        for k, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
            write(rows[lo:hi], f"{name}_{k}")
            next((tmp_path / f"{name}_{k}").glob("part-*.parquet")).rename(at / f"part-{k:05d}.parquet")
        return spark.read.parquet(str(at))

    source = table("s", rows, [300, 600])
    same = joins.compared_in_order(source, table("c", rows, [10, 11, 990]))
    assert {tuple(r)[1:] for r in same.collect()} == {(1000, 0, None, 0, 0)}
    swapped = [*rows[:400], rows[401], rows[400], *rows[402:-1]]
    got = {r["column"]: tuple(r)[1:] for r in joins.compared_in_order(source, table("w", swapped, [700])).collect()}
    assert got["a"] == (999, 2, 400, 1, 0) and got["b"][1:3] == (2, 400)


def test_publish_a_wide_table(spark, tmp_path):
    df = spark.range(5).selectExpr("id", *(f"id + {k} AS c{k}" for k in range(149)))
    assert len(files.publish(df, str(tmp_path / "t"))["columns"]) == 150
    assert len(files.read_json(spark, str(tmp_path / "t.manifest"))["columns"]) == 150


@pytest.mark.parametrize(
    ("change", "message"),
    [({"origins": ()}, "no origins"), ({"origins": (ORIGIN, ORIGIN)}, "unique"), ({"store_batches": ((1,), ())}, "empty"), ({"store_batches": ((1,), (1,))}, "more than one batch"), ({"max_items": 0}, "positive"), ({"manifest": "/root/testdata/sf0.001/nation.parquet"}, "different paths"), ({"output": "/root/testdata/sf0.001/nation.parquet/x"}, "none within"), ({"origins": (), "max_items": 0}, "positive; .*no origins")],
)
def test_build_config(spark, change, message):
    good = {"source": "/root/testdata/sf0.001/nation.parquet", "output": "/tmp/o", "manifest": "/tmp/m", "origins": (ORIGIN,), "store_batches": ((1,),)}
    build.Build(**good).check(spark)
    with pytest.raises(ValueError, match=message):
        build.Build(**(good | change)).check(spark)
    with pytest.raises(FileNotFoundError):
        build.Build(**(good | {"source": "/nowhere"})).check(spark)
    with pytest.raises(FileExistsError, match="region"):
        build.Build(**(good | {"output": "/root/testdata/sf0.001/region.parquet"})).check(spark)


def test_preservation(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", 1.0), (3, None, 2.0)], "k int, v string, x double")
    rows.write.parquet(str(tmp_path / "s"))
    assert all(build.preserve(spark, str(tmp_path / "s"), str(tmp_path / "c"), ["k"], ["k"])["checked"].values())
    failed = lambda copy: {r["rule"] for r in build.preservation(rows, copy, ["k"], ["k"]).where("not passed").collect()}
    assert failed(rows.withColumn("x", rows["x"] + 1)) == {"no changed value"}
    assert {"rows", "no lost rows"} <= failed(rows.where("k < 3"))
    assert {"rows", "unique grain"} <= failed(rows.union(rows))
    assert failed(rows.withColumn("k", rows["k"].cast("long"))) == {"columns and types"}
    with pytest.raises(ValueError, match="required columns"):
        build.preserve(spark, str(tmp_path / "s"), str(tmp_path / "d"), ["k"], ["v"])


def test_approved_folds(spark):
    folds.check_approved()
    with pytest.raises(ValueError, match="exactly 8"):
        folds.check_approved(folds.APPROVED[:7])
    with pytest.raises(ValueError, match="overlap"):
        folds.check_approved(folds.APPROVED, Fold(9, date(2017, 7, 10)))
    df = spark.createDataFrame([(date(2015, 9, 1),), (date(2015, 8, 31),)], "day date")
    assert df.where(folds.is_known("day", folds.APPROVED[0].origin)).count() == 1


def test_attributes_and_dictionary_raise(spark):
    base = spark.createDataFrame([(1,), (2,)], "k int")
    good = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert {tuple(r) for r in joins.attributes(base, good, ["k"]).collect()} == {(1, "a"), (2, "b")}
    for bad, message in ((good.where("k = 1"), "unmatched"), (good.union(good), "repeated"), (spark.createDataFrame([(1, "a"), (2, None)], "k int, v string"), "null v")):
        with pytest.raises(Exception, match=message):
            joins.attributes(base, bad, ["k"]).collect()
    assert [r["n"] for r in joins.looked_up(base, {1: "x", 2: "y"}, "k", "n").orderBy("k").collect()] == ["x", "y"]
    with pytest.raises(Exception, match="no entry for 2"):
        joins.looked_up(base, {1: "x"}, "k", "n").collect()


def test_sample_does_not_depend_on_the_split(spark):
    rows = spark.range(1000)
    one, two = ({r["id"] for r in sequences.sampled(rows.repartition(n), ["id"], 50, seed=3).collect()} for n in (1, 7))
    assert one == two and len(one) == 50
    assert one != {r["id"] for r in sequences.sampled(rows, ["id"], 50, seed=4).collect()}


def test_chosen_keys_raise(spark):
    totals = spark.createDataFrame([(1, 5.0), (2, 4.0), (3, 4.0)], "k int, t double")
    assert {r["k"] for r in sequences.chosen(totals, "k", "t", 1, [3]).collect()} == {1, 3}
    assert {r["k"] for r in sequences.chosen(totals, "k", "t", 1, [3, 3, 1]).collect()} == {1, 3}
    for n, asked, message in ((0, [], "within 1"), (11, [], "within 1"), (1, [9], "does not occur")):
        with pytest.raises(ValueError, match=message):
            sequences.chosen(totals, "k", "t", n, asked)
