import json

import pytest
from pyspark.sql import functions as F

from halyard.sources import readers, sinks

CARD = """
[task]
id = "u1"
[metadata]
category = "F1"
[targets]
asset_ids = ["A"]
horizons = [1, 5]
n_draws_min = 0
[scoring.params]
n_draws_min = 300
[panels.px]
asset_ids = ["A"]
frequency = "monthly"
[provenance]
data_cutoff = "2024-02-01T00:00"
"""


@pytest.fixture
def folder(tmp_path, spark):
    (tmp_path / "card.toml").write_text(CARD)
    spark.createDataFrame([("2024-01-01x", "A", 1.0)], "date string, asset_id string, value double").toPandas().to_parquet(tmp_path / "px.parquet")
    spark.range(3).toPandas().to_parquet(tmp_path / "other.parquet")
    text = tmp_path / "text"
    text.mkdir()
    for n in ("a", "b"):
        (text / f"{n}.txt").write_text(f"text {n}")
    (text / "corpus_index.json").write_text(json.dumps({"documents": [{"doc_id": "d1", "file": "a.txt", "timestamp": "2024-01-05T10:00"}]}))
    return tmp_path


def test_cards_and_panels(spark, folder):
    unit = readers.read_cards(spark, f"{folder}/card.toml").first()
    assert (unit.unit_id, unit.n_draws_min, str(unit.asof), unit.panel_meta[0].frequency) == ("u1", 300, "2024-02-01", "monthly")
    rows = readers.read_panels(spark, str(folder), "u1").collect()
    assert [(r.panel, r.asset, str(r.date), r.value) for r in rows] == [("px", "A", "2024-01-01", 1.0)]


def test_corpus(spark, folder):
    from halyard.operators.evidence import indexed_docs

    index, files = readers.read_corpus(spark, f"{folder}/text", "u1")
    got = sorted((r.doc_id, r.day, r.text) for r in indexed_docs(index, files).collect())
    assert got == [("b", "", "text b"), ("d1", "2024-01-05", "text a")]


def test_adjustments(spark, tmp_path):
    (tmp_path / "u1.json").write_text(json.dumps({"scenarios": [{"name": "n", "weight": 1, "drift": {"A": 0.2}, "vol_mult": {"B": 1.5}}], "tail_df": 5}))
    got = sorted((r.asset, r.drift, r.vol_mult, r.established, r.tail_df) for r in readers.read_adjustments(spark, f"{tmp_path}/u1.json").collect())
    assert got == [("A", 0.2, None, False, 5.0), ("B", None, 1.5, False, 5.0)]


def test_draws_are_finite_and_come_back(spark, tmp_path):
    units = spark.createDataFrame([("u1", ["B", "A"]), ("a b/.._c", ["A", "B"])], "unit_id string, assets array<string>")
    rows = [(u, d, a, h, float(d + h)) for u in ("u1", "a b/.._c") for d in range(30) for a in "AB" for h in (5, 1)]
    drawn = spark.createDataFrame(rows, "unit_id string, draw int, asset string, horizon int, value double").repartition(5)
    sinks.write_draws(drawn, units, f"{tmp_path}/draws")
    back = readers.read_draws(spark, f"{tmp_path}/draws")
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    first = [tuple(r)[1:4] for r in back.where("unit_id = 'u1'").collect()][:5]
    assert first == [(0, "B", 1), (0, "B", 5), (0, "A", 1), (0, "A", 5), (1, "B", 1)]  # in order of draw, the card's assets, horizon
    with pytest.raises(Exception, match="finite"):
        sinks.write_draws(drawn.withColumn("value", F.lit(float("nan"))), units, f"{tmp_path}/bad")
    assert readers.read_draws(spark, f"{tmp_path}/bad").count() == 0


def test_a_failed_attempt_leaves_nothing_to_readers(spark, tmp_path):
    """A task that fails after it has written, and is run again, and a job that fails for good."""
    from halyard.sources.unit_files import UnitFiles, UnitFileWriter, read_unit_files, write_unit_files

    good = spark.createDataFrame([(f"u{i}", f"text {i}") for i in range(20)], "unit_id string, value string")
    path = f"{tmp_path}/texts"
    write_unit_files(good, path, "note.txt")
    writer = UnitFileWriter(path, "note.txt", True)
    lost = writer.write(iter(good.where("unit_id = 'u3'").withColumn("value", F.lit("half")).toArrow().to_batches()))
    assert (lost.units, lost.rows) == (1, 1)  # it ended, but its job never committed
    assert {r.value for r in read_unit_files(spark, path, "note.txt").collect()} == {f"text {i}" for i in range(20)}
    broken = good.withColumn("value", F.when(F.col("unit_id") == "u7", F.raise_error(F.lit("lost executor"))).otherwise("new"))
    with pytest.raises(Exception, match="lost executor"):
        write_unit_files(broken, path, "note.txt")
    assert {r.value for r in read_unit_files(spark, path, "note.txt").collect()} == {f"text {i}" for i in range(20)}
    # an append replaces units that it writes again and keeps the others
    write_unit_files(good.where("unit_id = 'u5'").withColumn("value", F.lit("second")), path, "note.txt", mode="append")
    got = {r.unit_id: r.value for r in read_unit_files(spark, path, "note.txt").collect()}
    assert len(got) == 20 and got["u5"] == "second" and got["u6"] == "text 6"
    with pytest.raises(Exception, match="not together"):
        list(UnitFileWriter(path, "note.txt", True).write(iter(spark.createDataFrame([("a", "1"), ("b", "1"), ("a", "2")], "unit_id string, value string").coalesce(1).toArrow().to_batches())))
    assert UnitFiles.name() == "halyard_unit_files"


def test_panels_of_two_thousand_units_in_one_plan(spark, tmp_path):
    import pandas as pd

    for i in range(2000):
        at = tmp_path / f"u{i:04}" / ("panels" if i % 2 else "")
        at.mkdir(parents=True)
        pd.DataFrame({"date": ["2024-01-02T09:00", "none"] if i % 3 else [pd.Timestamp("2024-01-02"), pd.NaT], "asset" if i % 5 else "asset_id": ["A", 7] if i % 5 == 1 else ["A", "7"], "value": [i, 2]}).astype({"asset" if i % 5 else "asset_id": str}).to_parquet(at / "px.parquet")
    (tmp_path / "u0001" / "panels" / "odd.parquet").write_bytes(b"PAR1 broken")
    pd.DataFrame({"x": [1]}).to_parquet(tmp_path / "u0001" / "panels" / "other.parquet")
    pd.DataFrame({"date": ["2024-01-01"], "asset": ["P"], "value": [9.0]}).to_parquet(tmp_path / "u0001" / "above.parquet")  # its folder `panels` goes first
    df = readers.read_panel_files(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == -(-2002 // 256)
    rows = df.where("problem is null")
    assert rows.count() == 4000 and rows.select("unit_id").distinct().count() == 2000 and rows.where("date is null").count() == 2000
    assert [tuple(r) for r in rows.where("unit_id = 'u1999' and date is not null").select("panel", "asset", F.col("date").cast("string"), "value", "tie").collect()] == [("px", "A", "2024-01-02", 1999.0, 0)]
    assert {r.unit_id for r in readers.read_panel_files(spark, str(tmp_path), ["u0003", "u0004"]).collect()} == {"u0003", "u0004"}
    bad = df.where("problem is not null").collect()
    assert [(r.unit_id, r.panel) for r in bad] == [("u0001", "odd")] and "odd.parquet" in bad[0].file


def test_units_of_a_folder(spark, folder, tmp_path_factory):
    """Cards above and inside `panels`, a broken card, none, and two of one name."""
    import shutil

    root = tmp_path_factory.mktemp("units")
    for name in ("one", "two", "twin"):
        shutil.copytree(folder, root / name)
        (root / name / "card.toml").write_text(CARD.replace('"u1"', '"two"' if name == "twin" else f'"{name}"'))
    shutil.copytree(folder, root / "deep" / "panels")
    (root / "deep" / "panels" / "card.toml").write_text(CARD.replace('"u1"', '"deep"').replace('data_cutoff = "2024-02-01T00:00"', ""))
    (root / "deep" / "card.toml").write_text(CARD)
    (root / "none").mkdir()
    (root / "wrong").mkdir()
    (root / "wrong" / "card.toml").write_text("[task]\nid = 1")
    (root / "one" / "bad.parquet").write_bytes(b"no")
    got = readers.load_units(spark, str(root))
    units = {r.unit_id: r for r in got.units.collect()}
    assert set(units) == {"one", "deep"} and str(units["deep"].asof) == "2024-01-01" and str(units["one"].asof) == "2024-02-01"
    assert {r.unit_id for r in got.panels.collect()} >= {"one", "deep"}
    assert sorted((r.unit_id, r.doc_id, r.day) for r in got.index.collect()) == [("one", "d1", "2024-01-05")]
    assert sorted((r.unit_id, r.file) for r in got.files.collect()) == [("one", "a.txt"), ("one", "b.txt")]
    problems = {(r.unit_id, r.problem.split(":")[0]) for r in got.problems.collect()}
    assert problems == {("two", "card"), ("wrong", "card"), ("none", "no card"), ("one", "panel bad")}


def test_the_card_of_a_folder(spark, folder):
    assert readers.find_card(spark, f"{folder}/text").endswith("card.toml")  # of the folder above
    with pytest.raises(FileNotFoundError):
        readers.find_card(spark, str(folder), f"{folder}/text/card.toml")


def test_caches_hold_each_key_once(spark, tmp_path):
    from halyard.sources import keyed

    schema = "unit_id string, model string, version string, doc_id string, answer string"
    rows = spark.createDataFrame([("u", "m", "1", str(i), f"a{i}") for i in range(6)] + [("u", "m", "1", "0", "b"), ("u", "m", "1", None, "x")], schema)
    path = f"{tmp_path}/cache"
    assert keyed.read_keyed(spark, path, schema).count() == 0
    assert keyed.append_keyed(rows, keyed.CARD_KEYS, path) == 1
    assert keyed.append_keyed(rows, keyed.CARD_KEYS, path) == 1  # a repeated append adds nothing, and no version
    assert keyed.append_keyed(rows.withColumn("version", F.lit("2")), keyed.CARD_KEYS, path) == 2
    held = keyed.read_keyed(spark, path, schema)
    assert held.count() == 12 and held.where("doc_id = '0'").select("answer").distinct().collect()[0].answer == "a0"
    docs = spark.createDataFrame([("u", str(i)) for i in range(8)], "unit_id string, doc_id string")
    assert sorted(r.doc_id for r in keyed.misses(docs, held, "m", "1").collect()) == ["6", "7"]
    assert keyed.misses(docs, held, "other", "1").count() == 8


def test_two_writers_add_no_duplicates(spark, tmp_path, monkeypatch):
    """A writer that finds its version taken leaves out what the other has added."""
    from halyard.sources import keyed

    schema = "unit_id string, model string, version string, answer string"
    path, put, turns = f"{tmp_path}/cache", keyed._put_once, []
    mine = spark.createDataFrame([(f"u{i}", "m", "1", "mine") for i in range(4)], schema)
    theirs = spark.createDataFrame([(f"u{i}", "m", "1", "theirs") for i in range(2, 6)], schema)

    def late(spark, path, version, folders):
        if not turns:
            turns.append(1)
            keyed.append_keyed(theirs, keyed.RAW_KEYS, path)
        return put(spark, path, version, folders)

    monkeypatch.setattr(keyed, "_put_once", late)
    assert keyed.append_keyed(mine, keyed.RAW_KEYS, path) == 2
    got = {r.unit_id: r.answer for r in keyed.read_keyed(spark, path, schema).collect()}
    assert keyed.read_keyed(spark, path, schema).count() == 6 and got == {"u0": "mine", "u1": "mine"} | {f"u{i}": "theirs" for i in range(2, 6)}
    monkeypatch.setattr(keyed, "MOST_FOLDERS", 2)
    keyed.append_keyed(mine.withColumn("version", F.lit("2")), keyed.RAW_KEYS, path)  # rewritten as one folder
    assert keyed.read_keyed(spark, path, schema).count() == 10 and len(keyed._latest(path)[1]) == 1


def test_summaries_join_their_columns(spark, tmp_path):
    a, b = spark.createDataFrame([("u1", 0.5)], "unit_id string, composite_score double"), spark.createDataFrame([("u2", "x")], "unit_id string, error string")
    sinks.write_summary([a, b], f"{tmp_path}/s")
    assert [r.unit_id for r in readers.read_summary(spark, f"{tmp_path}/s").collect()] == ["u1"]


def test_the_last_row_of_a_unit_wins(spark, tmp_path):
    (tmp_path / "s.csv").write_text("unit_id,composite_score\nu1,0.5\nu2,0.1\nu1,0.7\nu1,\n")
    assert {r.unit_id: r.composite_score for r in readers.read_summary(spark, f"{tmp_path}/s.csv").collect()} == {"u1": 0.7, "u2": 0.1}


def test_a_run_is_written_and_taken_back(spark, tmp_path):
    from halyard.operators import batch
    from tests.test_batch import PANEL, panel_rows, unit

    rows = spark.createDataFrame([r for n in ("a", "b") for r in panel_rows(n)], PANEL)
    units = spark.createDataFrame([unit("a"), unit("b"), unit("c")], readers.UNIT_SCHEMA)
    f = batch.forecast(rows, units, n_draws=200)
    docs = spark.createDataFrame([("a", "d1", "2020-01-05", "note")], "unit_id string, doc_id string, day string, kind string")
    with pytest.raises(ValueError, match="folder of the draws"):
        sinks.write_forecasts(f, f"{tmp_path}/out", f"{tmp_path}/out/info")
    sinks.write_forecasts(f, f"{tmp_path}/out", f"{tmp_path}/info", docs)
    key = ["unit_id", "draw", "asset", "horizon"]
    a, b = (x.orderBy(*key).toPandas()[[*key, "value"]] for x in (readers.read_draws(spark, f"{tmp_path}/out"), f.draws))
    assert a.equals(b)
    cells = {(r.unit_id, r.asset, r.horizon): r.q50 for r in readers.read_ledgers(spark, f"{tmp_path}/info").collect()}
    assert cells == {(r.unit_id, r.asset, r.horizon): r.q50 for r in f.quantiles.collect()} and len(cells) == 8
    text = {r.unit_id: r.value for r in readers.read_unit_files(spark, f"{tmp_path}/out", "rationale.md").collect()}
    assert set(text) == {"a", "b"} and "| A | px | log |" in text["a"] and "`d1` 2020-01-05 note" in text["a"] and "moved nothing" in text["a"] and "No document was at hand." in text["b"]
    problems = {r.unit_id: json.loads(r.value) for r in readers.read_unit_files(spark, f"{tmp_path}/out", "problems.json").collect()}
    assert [p["asset"] for p in problems["c"]] == ["A", "B"]


def test_outcomes_are_written_and_reported(spark, tmp_path):
    outcomes = spark.createDataFrame([("a", "A", 1, 2.0), ("a", "B", 1, 3.0)], "unit_id string, asset string, horizon int, value double")
    sinks.write_realized(outcomes, f"{tmp_path}/o")
    assert sorted(map(tuple, readers.read_realized(spark, f"{tmp_path}/o").collect())) == sorted(map(tuple, outcomes.collect()))
    from tests.test_batch import PANEL, panel_rows

    panels = spark.createDataFrame(panel_rows("a") + panel_rows("b"), PANEL)
    units = spark.createDataFrame([("a",), ("b",)], "unit_id string")
    sinks.write_outcome_report(sinks.outcome_report(panels, units, outcomes), f"{tmp_path}/o")
    got = sinks.read_outcome_report(f"{tmp_path}/o")
    assert (got["units"], got["realized"], got["void"], got["panels"], got["series"], got["rows"], got["first"]) == (2, 1, 1, 1, 2, 180, "2020-01-01")
    assert [r.unit_id for r in sinks.void_units(units, outcomes).collect()] == ["b"]
