import datetime

from pyspark.sql import functions as F

from metricloom import catalog
from metricloom.catalog import EmitterSettings
from metricloom.functions import dims as D
from metricloom.functions import values as V
from metricloom.operators import normalize as N
from metricloom.sources.formats import EVENT_SCHEMA

SETTINGS = EmitterSettings(cluster="c1")
AT = datetime.datetime(2024, 1, 1)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def raw(name, string=None, items=None, other=None):
    return (name, string, items, other)


def event(kind="metric", metric="task/success/count", value=1.0, dims=(), event_id=1, ts=AT):
    return (event_id, kind, ts, "svc/x", "host-1", metric, value, None, None, list(dims))


def events(spark, rows):
    return spark.createDataFrame(rows, EVENT_SCHEMA)


def clean(spark, dims):
    return events(spark, [event(dims=dims)]).select(D.clean_dims(F.col("dims")).alias("v")).first()["v"]


def test_scrub(spark):
    assert one(spark, D.scrub(F.lit("[ hello world : ]"))) == "helloworld-"
    assert one(spark, D.scrub(F.lit("\u0000a\tb\u0001"))) == "ab"


def test_blocked_and_numeric_dims_vanish(spark):
    assert clean(spark, [raw("id", "x"), raw("dimension", "y"), raw("numDimensions", other="2")]) == []
    assert clean(spark, [raw(name, "x") for name in catalog.BLOCKED_DIMS]) == []


def test_kept_dims(spark):
    kept = clean(spark, [
        raw("a", "one"), raw("b", "[two]"), raw("c", items=["three"]), raw("d", "f:our"),
        raw("e", items=["x", "y"]), raw("f", items=[]), raw("g", other="5"), raw("h", " [] "), raw("i", items=[None]),
    ])
    assert [(d["name"], d["value"]) for d in kept] == [("a", "one"), ("b", "two"), ("c", "three"), ("d", "f-our")]


def test_metric_datum_has_four_dims(spark):
    rows = [event(dims=[raw("dataSource", "d"), raw("taskType", "t")])]
    datum = N.metric_datums(events(spark, rows), SETTINGS).first()
    assert datum["value"] == 1.0 and datum["unit"] == "Count"
    assert [(d["name"], d["value"]) for d in datum["dims"]] == [
        ("Engine.Service", "svc/x"), ("Engine.Cluster", "c1"), ("dataSource", "d"), ("taskType", "t")]


def test_duplicate_names_are_kept_and_implicit_dims_unscrubbed(spark):
    rows = [event(dims=[raw("Engine.Service", "other")])]
    datum = N.metric_datums(events(spark, rows), EmitterSettings(cluster="[c : 1]")).first()
    assert [d["value"] for d in datum["dims"]] == ["svc/x", "[c : 1]", "other"]


def test_alert_datum(spark):
    datum = N.alert_datums(events(spark, [event(kind="alert", metric=None, value=None)]), SETTINGS).first()
    assert (datum["name"], datum["value"], datum["unit"], len(datum["dims"])) == ("Engine.Alert", 1.0, "Count", 2)


def test_allow_list_is_exact(spark):
    names = ["query/time", "jvm/gc/cpu", "segment/count", "Query/time", "query/time ", "none"]
    rows = [event(metric=name, event_id=i) for i, name in enumerate(names)]
    kept = N.metric_datums(events(spark, rows), SETTINGS)
    assert {r["name"] for r in kept.collect()} == {"query/time", "jvm/gc/cpu", "segment/count"}


def test_units(spark):
    names = spark.createDataFrame([("query/time",), ("query/cpu/time",), ("nothing",)], "metric string")
    units = {r["metric"]: r["unit"] for r in N.with_unit(names).collect()}
    assert units == {"query/time": "Milliseconds", "query/cpu/time": "Microseconds", "nothing": "Count"}


def test_nanoseconds_become_whole_milliseconds(spark):
    assert one(spark, V.stored_value(F.lit("jvm/gc/cpu"), F.lit(1_999_999.0))) == 1.0
    assert one(spark, V.stored_value(F.lit("jvm/gc/cpu"), F.lit(-1_999_999.0))) == -1.0
    assert one(spark, V.stored_value(F.lit("query/time"), F.lit(1.5))) == 1.5


def test_dispatch(spark):
    rows = [event(event_id=1), event(kind="alert", event_id=2), event(kind="odd", event_id=3),
            event(kind=None, event_id=4), event(value=None, event_id=5), event(metric=None, event_id=6)]
    routes = [r["route"] for r in N.dispatch(events(spark, rows)).orderBy("event_id").collect()]
    assert routes == ["metric", "alert", "invalid", "invalid", "fatal", "fatal"]


def test_rollup_keeps_listed_dims_and_converts_ranges(spark):
    rows = [
        event(metric="query/cache/total/hitRate", value=0.25, dims=[raw("dataSource", "d")], event_id=1),
        event(metric="segment/used", value=3.0, dims=[raw("tier", "t"), raw("server", "s")], event_id=2),
        event(metric="unmapped", event_id=3),
    ]
    out = {r["event_id"]: r for r in N.statsd_rows(events(spark, rows), SETTINGS).collect()}
    assert set(out) == {1, 2}
    assert out[1]["value"] == 25.0 and out[1]["dims"] == []
    assert [d["name"] for d in out[2]["dims"]] == ["tier"] and out[2]["tags"] == ["cluster_name:c1"]


def test_catalogue_sizes():
    assert len(catalog.unit_rows()) == 91 and len({r["metric"] for r in catalog.unit_rows()}) == 91
    kinds = [r["rollup_kind"] for r in catalog.rollup_rows()]
    assert (len(kinds), kinds.count("gauge"), kinds.count("count"), kinds.count("timer")) == (152, 79, 58, 15)
    assert sum(r["convert_range"] for r in catalog.rollup_rows()) == 3
    assert len(catalog.role_rows()) == 26


def test_dimension_match(spark):
    dims = F.array(D.dim("a", F.lit("1")), D.dim("b", F.lit("2")))
    assert one(spark, D.matches_dims(dims, {"a": "1", "b": "2"}))
    assert not one(spark, D.matches_dims(dims, {"a": "1"}))
    assert one(spark, D.matches_dims(dims, {"a": "1"}, "subset"))
    assert not one(spark, D.matches_dims(dims, {"a": "2"}, "subset"))
    assert one(spark, D.series_id(F.array(D.dim("b", F.lit("2")), D.dim("a", F.lit("1"))))) == one(
        spark, D.series_id(dims))


def test_steps(spark):
    steps = [(None, 30.0, -1), (60.0, 80.0, 1), (80.0, None, 3)]
    got = [one(spark, V.step_change(F.lit(v), steps)) for v in (29.9, 30.0, 59.9, 60.0, 79.9, 80.0)]
    assert got == [-1, 0, 0, 1, 1, 3]
