"""Guards, contracts, sinks, suppression and review parts that SQL cannot state."""

import pytest
from pyspark.sql import functions as F

from halfseen.operators import disclosure as dc
from halfseen.operators import review as rv
from halfseen.operators import validate as vd
from halfseen.sources import reader, sinks


def test_missing_input_names_the_path(spark, tmp_path):
    with pytest.raises(reader.MissingInput, match="nowhere"):
        reader.find(spark, [str(tmp_path / "nowhere.csv")], "registry")
    with pytest.raises(reader.MissingInput, match="at least one"):
        reader.find_any(spark, {"a": [str(tmp_path / "x")], "b": [str(tmp_path / "y")]})


def test_contract_read(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    (tmp_path / "t.csv").write_text("id,when,extra\n1,2020-01-02 03:04:05,x\n2,not a date,y\n")
    got = reader.load(spark, path, "t", ("id", "when"), datetimes=("when",)).collect()
    assert got[0]["when"] is not None and got[1]["when"] is None and got[0]["extra"] == "x"
    assert reader.load(spark, path, "t", ("id",), columns=("id",), rows=1).count() == 1
    with pytest.raises(reader.ContractViolation, match="absent"):
        reader.load(spark, path, "t", ("id", "absent"))


def test_prepared_round_trip_and_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5)], "id long, x double")
    for fmt in ("parquet", "csv"):
        sinks.write_prepared(df, str(tmp_path / fmt), {"data_source": "fixture"}, fmt=fmt)
        units, record = sinks.read_prepared(spark, str(tmp_path / fmt))
        assert units.count() == 1 and record["data_source"] == "fixture"
    with pytest.raises(ValueError, match="data_source"):
        sinks.write_result(df, str(tmp_path / "r"), "made up")
    with pytest.raises(ValueError, match="fixture"):
        reader.claim_root("/data/fixtures/a", "real")
    both = reader.provenance(df, "a", "real").union(reader.provenance(df, "b", "fixture"))
    assert not reader.all_real(both) and reader.all_real(both.filter("name = 'a'"))
    rows = both.collect()
    assert rows[0]["fingerprint"] == rows[1]["fingerprint"]


def test_interval_file(spark, tmp_path):
    p = tmp_path / "i.json"
    p.write_text('{"gamma": 2.0, "auroc_lo": 0.4, "auroc_hi": 0.6, "by_gamma": {"1.0": {"auroc_lo": 0.5, "auroc_hi": 0.5},'
                 ' "3": {"auroc_lo": 0.3, "auroc_hi": 0.7}}, "nuisances": {"scores": [1, 2], "p1": [0.1, 0.2], "e": [0.5, 0.5]}}')
    rows = reader.read_intervals(spark, str(p))
    assert reader.choose_interval(rows).collect()[0]["gamma"] == 2.0
    assert reader.choose_interval(rows, 3.0).collect()[0]["lower"] == 0.3
    with pytest.raises(reader.MissingInput):
        reader.choose_interval(rows, 9.0)
    assert reader.read_interval_units(spark, str(p)).count() == 2
    p.write_text('{"gamma": 0.5, "auroc_lo": 0.4, "auroc_hi": 0.6}')
    with pytest.raises(reader.ContractViolation):
        reader.read_intervals(spark, str(p))


def test_review_csv_keeps_blank_and_na_apart(spark, tmp_path):
    (tmp_path / "r.csv").write_text("id,truth\n1,\n2,NA\n3,55\n")
    got = reader.read_review(spark, str(tmp_path / "r.csv")).withColumn("v", rv.parse_answer_cell("truth"))
    assert [r["v"] for r in got.orderBy("id").collect()] == [None, -1.0, 55.0]


def test_measurement_aliases():
    assert reader.match_columns(["Study", " EF", "mr_severity"])["lvef"] == " EF"


def test_forbidden_names():
    with pytest.raises(vd.ForbiddenFeature):
        vd.refuse_forbidden(["age", "lvef_last"])
    vd.refuse_forbidden(["age_at_record", "lab_click"])


def test_hidden_signal(spark):
    base = spark.range(400).select(F.rand(1).alias("a"), F.rand(2).alias("b"), F.randn(3).alias("s"))
    cases = {"s_copy": F.col("s"), "mono": F.exp("s"), "mix": None}
    for name in ("s_named", "copy", "mono"):
        df = base.withColumn(name, {"s_named": F.col("a"), "copy": F.col("s"), "mono": cases["mono"]}[name])
        with pytest.raises(vd.HiddenSignalLeak):
            vd.refuse_hidden_signal(df.withColumnRenamed("s", "sig") if name != "s_named" else df.withColumnRenamed("s", "s_n"),
                                    ["b", name], "sig" if name != "s_named" else "s_n")
    joint = base.withColumn("c", F.col("s") - F.col("a")).withColumn("d", F.col("a") + 0.01 * F.col("b"))
    with pytest.raises(vd.HiddenSignalLeak, match="jointly"):
        vd.refuse_hidden_signal(joint.withColumnRenamed("s", "sig").withColumn("c", F.col("sig") - 3 * F.col("a")), ["c", "d"], "sig")
    ok = base.withColumn("n", 0.5 * F.col("s") + F.randn(9)).withColumnRenamed("s", "sig")
    vd.refuse_hidden_signal(ok, ["a", "b", "n"], "sig")


def test_aggregate_guard(spark):
    df = spark.range(100).withColumnRenamed("id", "n")
    with pytest.raises(AssertionError, match="rows"):
        vd.refuse_unit_level(df, ["subject_id"])
    with pytest.raises(AssertionError, match="identifiers"):
        vd.refuse_unit_level(df.withColumnRenamed("n", "Subject_ID").limit(2), ["subject_id"])
    with pytest.raises(AssertionError, match="arrays"):
        vd.refuse_unit_level(df.agg(F.collect_list("n").alias("all")), ["subject_id"])


def test_selective_invariants(spark):
    bad = spark.createDataFrame([(1, None), (0, 1.0)], "t int, y_obs double")
    with pytest.raises(ValueError, match="invariants"):
        vd.require_selective(bad)


def test_suppression_leaves_no_single_hidden_cell(spark):
    rows = [("a", "x", 3), ("a", "y", 40), ("b", "x", 30), ("b", "y", 20), ("c", "x", 50), ("c", "y", 60), ("c", "z", 0)]
    got = dc.suppress_table(spark.createDataFrame(rows, "r string, c string, n long"), "r", "c", "n").collect()
    hidden = {(g["row"], g["col"]): g["reason"] for g in got if g["suppressed"]}
    assert hidden[("a", "x")] == "primary" and len(hidden) == 4
    for axis in (0, 1):
        for line in {k[axis] for k in hidden}:
            assert sum(k[axis] == line for k in hidden) != 1
    assert all(g["n"] is None for g in got if g["suppressed"])


def test_allocation():
    assert rv.allocate({"p": 100, "n": 100, "m": 100}, 30) == {"p": 10, "n": 10, "m": 10}
    got = rv.allocate({"p": 2, "n": 100, "m": 0}, 30)
    assert got == {"p": 2, "n": 28, "m": 0}
    assert sum(rv.allocate({"p": 2, "n": 3, "m": 1}, 30).values()) == 6


def test_null_strata_are_kept(spark):
    df = spark.range(50).select("id", F.when(F.col("id") % 2 == 0, 1).alias("s"))
    folds = vd.stratified_folds(df, ["s"], "id", 5, "x")
    assert folds.count() == 50
    assert {(r["s"], r["fold"]): r["count"] for r in folds.groupBy("s", "fold").count().collect()} == {
        (s, f): 5 for s in (None, 1) for f in range(5)}


def test_layouts_full_contract_and_note_breaks(spark, tmp_path):
    from halfseen.sources import contracts
    root = tmp_path / "data"
    (root / "hosp").mkdir(parents=True)
    (root / "mimic-iv-note/2.2/note").mkdir(parents=True)
    import gzip
    with gzip.open(root / "hosp/patients.csv.gz", "wt") as f:
        f.write("subject_id,gender,anchor_age,anchor_year,anchor_year_group,dod,more\n1,F,60,2150,2008 - 2010,2151-02-03,x\n2,M,61,2150,g,not a date,y\n")
    with gzip.open(root / "mimic-iv-note/2.2/note/discharge.csv.gz", "wt") as f:
        f.write(",".join(contracts.CLINICAL["discharge"]) + '\nn1,1,2,DS,1,2150-01-01 00:00:00,2150-01-02 00:00:00,"line one\nline ""two"""\n')
    p = reader.load_table(spark, str(root), "patients").orderBy("subject_id").collect()
    assert p[0]["dod"] is not None and p[1]["dod"] is None and p[0]["more"] == "x"
    assert reader.load_table(spark, str(root), "discharge").collect()[0]["text"] == 'line one\nline "two"'
    with gzip.open(root / "hosp/transfers.csv.gz", "wt") as f:
        f.write("subject_id,careunit,intime,outtime\n1,a,b,c\n")
    with pytest.raises(reader.ContractViolation, match="transfer_id"):
        reader.load_table(spark, str(root), "transfers")
    with pytest.raises(reader.MissingInput):
        reader.load_table(spark, str(root), "triage")
    with pytest.raises(KeyError):
        reader.load_table(spark, str(root), "nonsense")


def test_discovery_of_measurements(spark, tmp_path):
    assert reader.discover(spark, str(tmp_path / "none"))[0] is None
    (tmp_path / "sub").mkdir()
    (tmp_path / "study-list.csv").write_text("subject_id,study_id\n1,2\n")
    (tmp_path / "a_report.csv").write_text("study_id,mr_grade\n1,mild\n")
    assert reader.discover(spark, str(tmp_path))[0] is None          # a grade alone does not count
    (tmp_path / "sub" / "measurements.csv").write_text("study_id,EF,IVS\n1,55,1.0\n")
    path, hit, searched = reader.discover(spark, str(tmp_path))
    assert path.endswith("measurements.csv") and hit == {"lvef": "EF", "ivsd": "IVS"} and searched[-1] == path


def test_format_follows_the_ending(spark, tmp_path):
    folder = tmp_path / "x.parquet_old"
    folder.mkdir()
    (folder / "y.csv").write_text("a\n1\n")
    assert reader.raw_table(spark, str(folder / "y.csv")).columns == ["a"]


def test_typed_csv_fingerprint_exact_split_nested_arrays(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, None), (2, None, "x")], "id long, x double, s string")
    sinks.write_prepared(df, str(tmp_path / "p"), {"data_source": "fixture"}, fmt="csv")
    units, _ = sinks.read_prepared(spark, str(tmp_path / "p"))
    assert units.dtypes == df.dtypes and sorted(map(tuple, units.collect())) == sorted(map(tuple, df.collect()))
    one, thrice = df.filter("id = 1"), df.filter("id = 1").union(df.filter("id = 1")).union(df.filter("id = 1"))
    prints = {reader.provenance(d, "a", "real").collect()[0]["fingerprint"] for d in (one, thrice)}
    assert len(prints) == 2
    sides = vd.split_exact(spark.range(101), "id", 0.3, "s").groupBy("side").count().collect()
    assert {r["side"]: r["count"] for r in sides} == {"test": 30, "train": 71}
    nested = spark.range(1).select(F.struct(F.sequence(F.lit(1), F.lit(99)).alias("a")).alias("s"))
    with pytest.raises(AssertionError, match="arrays"):
        vd.refuse_unit_level(nested, ["id"])
    deep = spark.range(1).select(F.array(F.struct(F.sequence(F.lit(1), F.lit(99)).alias("a"))).alias("s"))
    with pytest.raises(AssertionError, match="arrays"):
        vd.refuse_unit_level(deep, ["id"])
    vd.refuse_unit_level(spark.range(3).select(F.array(F.lit(1)).alias("k")), ["id"])
