import datetime as dt

import pytest
from pyspark.sql import functions as F

from kilocast.errors import InvalidParameter
from kilocast.operators import checks, mapping


def _points(spark, hours):
    start = dt.datetime(2018, 1, 1)
    rows = [(s, start + dt.timedelta(minutes=60 * h)) for s, hs in hours.items() for h in hs]
    return spark.createDataFrame(rows, "sector string, timestamp timestamp_ntz")


def _found(df):
    start = dt.datetime(2018, 1, 1)
    return {(r.issue, r.sector, (r.timestamp - start).total_seconds() / 3600) for r in df.collect()}


def test_complete_series_pass(spark):
    df = _points(spark, {"a": range(5), "b": range(5)})
    assert checks.time_gaps(df, ["sector"], 1).isEmpty()


def test_missing_and_misplaced_timestamps(spark):
    # c has as many points as steps, one of them off the grid.
    df = _points(spark, {"a": [0, 1, 2, 3], "b": [0, 2, 3], "c": [0, 1.5, 2, 3]})
    assert _found(checks.time_gaps(df, ["sector"], 1)) == {
        ("missing", "b", 1),
        ("missing", "c", 1),
        ("misplaced", "c", 1.5),
    }


def test_given_bounds(spark):
    df = _points(spark, {"a": [0, 1, 2, 9]})
    gaps = checks.time_gaps(df, ["sector"], 1, "2018-01-01 00:00:00", "2018-01-01 03:00:00")
    assert _found(gaps) == {("missing", "a", 3), ("misplaced", "a", 9)}


def test_gaps_cross_blocks_and_series_may_be_all_wrong(spark, monkeypatch):
    monkeypatch.setattr(checks, "BLOCK", 4)
    hours = {"a": [0, 1, 5, 6, 7, 8, 19], "b": [0.5], None: [3, 3, 18], "d": [0, 19.25]}
    df = _points(spark, hours).unionByName(spark.createDataFrame([("a", None)], "sector string, timestamp timestamp_ntz"))
    found = checks.time_gaps(df, ["sector"], 1, "2018-01-01 00:00:00", "2018-01-01 19:00:00")
    rows = {(r.issue, r.sector, r.timestamp and (r.timestamp - dt.datetime(2018, 1, 1)).total_seconds() / 3600) for r in found.collect()}
    expected = {("misplaced", "a", None), ("misplaced", "b", 0.5), ("misplaced", "d", 19.25), ("duplicate", None, 3.0)}
    for sector, there in hours.items():
        expected |= {("missing", sector, float(h)) for h in range(20) if h not in there}
    assert rows == expected and found.count() == len(expected)


def test_only_gaps_are_spelt_out(spark):
    df = _points(spark, {"a": range(0, 90, 3), "b": [0, 87]})
    text = checks.time_gaps(df, ["sector"], 3)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Generate explode(sequence(_from") == 1 and text.count("Generate") == 1
    assert checks.time_gaps(df, ["sector"], 3).groupBy("sector").count().collect() == [("b", 28)]


def test_time_checks_do_not_depend_on_the_zone(spark):
    df = _points(spark, {"a": [h for h in range(24 * 120) if h != 2000], "b": range(24 * 120)})
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert _found(checks.time_gaps(df, ["sector"], 1)) == {("missing", "a", 2000)}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_a_million_records(spark):
    dims = ["geography", "sector", "metric"]
    sectors, metrics = [f"s{i}" for i in range(7)], [f"m{i}" for i in range(10)]
    records = spark.range(1_000_000).select(F.concat(F.lit("r"), "id").alias("geography"))
    some = records.filter("geography like '%77777'")
    whole = some.withColumn("sector", F.explode(F.lit(sectors))).withColumn("metric", F.explode(F.lit(metrics)))
    there = whole.filter("not (sector = 's6' and metric = 'm9')")
    gaps = checks.association_gaps(there, some, {"sector": sectors, "metric": metrics})
    assert {tuple(r) for r in gaps.collect()} == {("missing", r[0], "s6", "m9") for r in some.collect()}
    one = records.withColumn("sector", F.lit("s")).filter("geography <> 'r4711'")
    gaps = checks.association_gaps(one, records, {"sector": ["s"]})
    assert [tuple(r) for r in gaps.collect()] == [("missing", "r4711", "s")]
    text = gaps._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in text and "NestedLoop" not in text and list(gaps.columns) == ["issue", *dims[:2]]


def test_associations(spark):
    dims = "geography string, sector string, metric string"
    df = spark.createDataFrame([("x", "s", "m"), ("y", "s", "n"), ("z", "s", "m")], dims)
    records = spark.createDataFrame([("x",), ("y",)], "geography string")
    allowed = spark.createDataFrame([("x", "s", "n")], dims)
    gaps = checks.association_gaps(df, records, {"sector": ["s"], "metric": ["m", "n"]}, allowed)
    assert {tuple(r) for r in gaps.collect()} == {
        ("missing", "y", "s", "m"),
        ("orphan", "z", "s", "m"),
    }


@pytest.fixture
def pairs(spark):
    return spark.createDataFrame([("a", "T"), ("b", "T"), ("c", "U")], "from_id string, to_id string")


def test_unknown_mapping_ids(spark, pairs):
    known = spark.createDataFrame([("a",), ("b",)], "id string")
    targets = spark.createDataFrame([("T",)], "id string")
    found = checks.unknown_mapping_ids(pairs, known, targets)
    assert {tuple(r) for r in found.collect()} == {("from", "c"), ("to", "U")}


def test_mapping_adds_up_or_renames(spark, pairs):
    df = spark.createDataFrame(
        [("a", 2030, 1.0), ("b", 2030, 2.0), ("c", 2030, 4.0), ("d", 2030, 8.0)],
        "geography string, model_year long, value double",
    )
    summed = mapping.map_dimension(df, pairs, "geography")
    assert {tuple(r) for r in summed.collect()} == {("T", 2030, 3.0), ("U", 2030, 4.0)}
    renamed = mapping.map_dimension(df, pairs, "geography", mapping.ONE_TO_ONE)
    assert sorted(tuple(r) for r in renamed.collect()) == [
        ("T", 2030, 1.0),
        ("T", 2030, 2.0),
        ("U", 2030, 4.0),
    ]
    with pytest.raises(InvalidParameter):
        mapping.map_dimension(df, pairs, "geography", "other")
