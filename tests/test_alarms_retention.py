import datetime

import pytest
from pyspark.sql import functions as F

from metricloom import catalog
from metricloom.catalog import AlarmRule
from metricloom.functions import iso
from metricloom.operators import alarms as A
from metricloom.operators import retention as R
from metricloom.operators.retention import Rule

T0 = datetime.datetime(2024, 1, 1)


def states(spark, rule, values):
    """``values`` per 5 minutes, None for a missing point."""
    rows = [(rule.name, T0 + datetime.timedelta(minutes=5 * i), v) for i, v in enumerate(values) if v is not None]
    points = spark.createDataFrame(rows, "alarm string, bucket timestamp_ntz, value double")
    done = A.evaluate(points, [], [rule], "5 minutes")
    return done, [r["state"] for r in done.orderBy("bucket").collect()]


def rule(compare=">", threshold=10.0, m=3, n=5, missing="not_breaching"):
    return AlarmRule("r", "metric", "avg", "5 minutes", compare, threshold, m, n, missing)


def test_three_of_five(spark):
    _, got = states(spark, rule(), [11.0, 1.0, 11.0, 1.0, 11.0, 1.0, 1.0, 11.0])
    assert got == ["OK", "OK", "OK", "OK", "ALARM", "OK", "OK", "OK"]


def test_threshold_itself_does_not_breach(spark):
    assert states(spark, rule(m=1, n=1), [10.0, 10.1])[1] == ["OK", "ALARM"]
    assert states(spark, rule("<=", m=1, n=1), [10.0, 10.1])[1] == ["ALARM", "OK"]
    assert states(spark, rule(">=", m=1, n=1), [10.0, 9.9])[1] == ["ALARM", "OK"]
    assert states(spark, rule("<", m=1, n=1), [10.0, 9.9])[1] == ["OK", "ALARM"]


def test_missing_modes(spark):
    values = [11.0, None, None, None, 11.0]
    assert states(spark, rule(m=1, n=2), values)[1] == ["ALARM", "ALARM", "OK", "OK", "ALARM"]
    assert states(spark, rule(m=1, n=2, missing="missing"), values)[1] == [
        "ALARM", "ALARM", "INSUFFICIENT_DATA", "INSUFFICIENT_DATA", "ALARM"]


def test_transitions(spark):
    done, _ = states(spark, rule(m=1, n=1), [11.0, 11.0, 1.0, 11.0])
    got = [(r["bucket"].minute, r["previous"], r["state"]) for r in A.transitions(done, []).orderBy("bucket").collect()]
    assert got == [(0, "NONE", "ALARM"), (10, "ALARM", "OK"), (15, "OK", "ALARM")]


def test_every_catalogue_rule_evaluates(spark):
    rows = [(r.name, T0 + datetime.timedelta(minutes=5 * i), r.threshold + (1.0 if r.compare == ">" else -1.0))
            for r in catalog.ALARM_RULES for i in range(5)]
    points = spark.createDataFrame(rows, "alarm string, bucket timestamp_ntz, value double")
    done = A.evaluate(points, [], list(catalog.ALARM_RULES), "5 minutes")
    last = {r["alarm"]: r["state"] for r in done.where(F.col("bucket") == F.lit(T0 + datetime.timedelta(minutes=20))).collect()}
    assert last == {r.name: "ALARM" for r in catalog.ALARM_RULES}


def test_iso_periods():
    assert iso.period_parts("P1Y2M3DT4H5M6S") == {"years": 1, "months": 2, "days": 3, "hours": 4, "mins": 5, "secs": 6}
    assert iso.period_parts("P2W") == {"weeks": 2}
    for bad in ("", "P", "1M", "P1H", "PT"):
        with pytest.raises(ValueError):
            iso.period_parts(bad)


def classify(spark, rules, as_of, days, **kw):
    rows = [(datetime.datetime.fromisoformat(d),) for d in days]
    df = spark.createDataFrame(rows, "t timestamp_ntz")
    return [(r["action"], r["rule_no"]) for r in R.apply_retention(df, "t", rules, as_of, **kw).orderBy("t").collect()]


def test_rules_by_type(spark):
    days = ["2011-12-31", "2012-01-01", "2013-01-01", "2024-02-28", "2024-02-29", "2024-03-31", "2024-04-01"]
    chain = [Rule("loadByPeriod", period="P1M", replicants={"hot": 2}),
             Rule("dropByInterval", interval="2012-01-01/2013-01-01"),
             Rule("broadcastByPeriod", period="P1D", include_future=True),
             Rule("dropBeforeByPeriod", period="P12Y"), Rule("loadForever")]
    # one month before 31 March is 29 February
    assert classify(spark, chain, "2024-03-31", days) == [
        ("drop", 4), ("drop", 2), ("load", 5), ("load", 5), ("load", 1), ("broadcast", 3), ("broadcast", 3)]


def test_unmatched_rows_fall_to_the_default_chain(spark):
    rules = [Rule("dropByInterval", interval="2012-01-01/2013-01-01")]
    assert classify(spark, rules, "2024-01-01", ["2012-05-05", "2020-01-01"]) == [("drop", 1), ("load", 2)]


def test_malformed_rules():
    for bad in (Rule("loadByPeriod"), Rule("dropByInterval"), Rule("sometimes"), Rule("loadBeforeByPeriod", period="P1D")):
        with pytest.raises(ValueError):
            bad.matches(F.lit(None), F.lit(None)) if bad.type != "sometimes" else bad.action()


def test_tier_bytes(spark):
    rows = [(datetime.datetime(2024, 3, 30), 10.0), (datetime.datetime(2020, 1, 1), 5.0), (datetime.datetime(2010, 1, 1), 7.0)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, bytes double")
    chain = [Rule("loadByPeriod", period="P1M", replicants={"hot": 3, "default": 1}),
             Rule("dropBeforeByPeriod", period="P10Y"), Rule("loadForever", replicants={"default": 2})]
    got = {r["tier"]: (r["bytes"], r["copies"]) for r in R.tier_bytes(df, "t", chain, "2024-03-31").collect()}
    assert got == {"hot": (30.0, 3), "default": (20.0, 3)}


def test_purge_reaches_the_scan(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    plan = R.purge(lines, "l_shipdate", "P60D", "1999-01-01")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThan(l_shipdate" in plan


@pytest.mark.parametrize("chain, pushed", [
    ([Rule("loadByPeriod", period="P3Y"), Rule("dropForever")], "1998-11-05"),
    ([Rule("dropByPeriod", period="P2W"), Rule("dropBeforeByPeriod", period="P1Y")], "2000-11-05"),
    ([Rule("loadByInterval", interval="1996-01-01/1996-02-01"), Rule("dropBeforeByPeriod", period="P1Y")], "1996-01-01"),
    ([Rule("loadForever"), Rule("dropForever")], None),
    ([Rule("dropByPeriod", period="P1Y")], None),
])
def test_retained_rows_and_their_pushed_bound(spark, folder, chain, pushed):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    kept = R.retained(lines, "l_shipdate", chain, "2001-11-05")
    plain = R.apply_retention(lines, "l_shipdate", chain, "2001-11-05").where("action <> 'drop'")
    assert kept.count() == plain.count() > 0
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert (f"GreaterThanOrEqual(l_shipdate,{pushed}T00:00)" in plan) == (pushed is not None)
