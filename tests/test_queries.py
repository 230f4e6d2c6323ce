import re

import pytest

import __spark_entry__ as contract
from metricloom import plans
from tests.compare import database, difference

QUERIES = plans.queries()
STATEMENTS = plans.statements()


@pytest.fixture(scope="module")
def con(folder):
    return database(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_statement(spark, folder, con, name):
    df = QUERIES[name](spark, folder)
    assert name in STATEMENTS
    assert difference(df, con, STATEMENTS[name]) is None


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["data_source", "bucket", "tm99"] and df.count() > 0


SURVEY_ROWS = (
    "S1 S2 S3 S4 S5 S6 S7 S8 S9 S10 S11 S12 S13 S14 K1 K2 K3 K4 K5 K6 K7 "
    + " ".join(f"P{i}" for i in range(1, 26)) + " J1 J2 J3 J4 J5 J6 J7 J8 J9 "
    + " ".join(f"G{i}" for i in range(1, 18)) + " W1 W2 W3 W4 W5 W6 W7 O1 O2 O4 X1 X2 X3 X4 "
    + " ".join(f"R{i}" for i in range(1, 13)) + " " + " ".join(f"T{i}" for i in range(1, 10))
    + " A1 A2 A3 E1 E2 E3 E4 E5 E6 E7 E8 E9 E10"
).split()


def test_every_survey_row_has_a_query():
    covered = set(re.findall(r"[A-Z]\d+", " ".join(plans.coverage().values())))
    assert set(SURVEY_ROWS) <= covered


# all pairs of two inputs never meet: no query may plan a cross join
@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("streamed_")))
def test_no_cross_join(spark, folder, name):
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
