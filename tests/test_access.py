import pytest
from pyspark.sql import functions as F

from metricloom import catalog
from metricloom.operators import access as A
from metricloom.operators import setops as S

REQUEST = ("request_id bigint, principal string, has_context boolean, claim string, resource_type string, "
           "resource_name string, action string")
GROUPS = [("admins", "administrator"), ("team-a", "a"), ("team-a", "read_state"), ("team-b", "b"), ("nothing", "empty")]
PERMISSIONS = [
    ("a", "DATASOURCE", "sales.*", "READ"), ("a", "DATASOURCE", "sales", "WRITE"), ("b", "DATASOURCE", "x|y", "READ"),
    ("read_state", "STATE", ".*", "READ"),
] + [tuple(r.values()) for r in catalog.role_rows()]


def decide(spark, requests, **kw):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(requests)], REQUEST)
    groups = spark.createDataFrame(GROUPS, "group string, role string")
    perms = spark.createDataFrame(PERMISSIONS, "role string, resource_type string, name_pattern string, action string")
    done = A.authorise(df, groups, perms, **kw).orderBy("request_id").collect()
    return [r["allowed"] for r in done]


def ask(claim, name="sales", action="READ", kind="DATASOURCE", principal="p", context=True):
    return (principal, context, claim, kind, name, action)


def test_claims(spark):
    assert decide(spark, [
        ask('["team-a"]'), ask("other, team-a"), ask("team-a", action="WRITE"), ask("team-b", action="WRITE"),
        ask(None), ask("team-a", principal=None), ask("team-a", context=False), ask("nobody"), ask("nothing"),
    ]) == [True, True, True, False, False, False, False, False, False]


def test_names_match_in_full(spark):
    assert decide(spark, [
        ask("team-a", "sales_2024"), ask("team-a", "my_sales"), ask("team-a", "sales_2024", "WRITE"),
        ask("team-b", "x"), ask("team-b", "xy"), ask("team-a", "sales\n", "WRITE"),
    ]) == [True, False, False, True, False, False]


def test_types_and_equality_of_groups(spark):
    assert decide(spark, [
        ask("team-a", kind="STATE"), ask("team-b", kind="STATE"), ask("team-.*"), ask("admins", kind="VIEW", action="WRITE"),
    ]) == [True, False, False, True]


def test_no_claim_configured_allows(spark):
    got = decide(spark, [ask(None), ask("x", principal=None), ask("x", context=False)], claim_configured=False)
    assert got == [True, False, False]


@pytest.mark.parametrize("claim, groups", [
    ("a,b", ["a", "b"]), (" a , b ", ["a", "b"]), ('["a","b"]', ["a", "b"]), ("[]", []), ("[1,2]", ["[1", "2]"]),
    ("a,,", ["a"]), (",a", ["", "a"]), ("", [""]), (",", []), ('["a, b"]', ["a, b"]), ("{}", ["{}"]),
])
def test_claim_groups(spark, claim, groups):
    assert spark.range(1).select(A.claim_groups(F.lit(claim)).alias("g")).first()["g"] == groups


def test_bag_of_permissions_keeps_duplicates(spark):
    groups = spark.createDataFrame([("g1", "r"), ("g2", "r")], "group string, role string")
    perms = spark.createDataFrame([("r", "STATE", ".*", "READ")] * 2,
                                  "role string, resource_type string, name_pattern string, action string")
    people = spark.createDataFrame([("p", "g1,g2,g1"), ("q", "none")], "principal string, claim string")
    assert A.permissions(people, groups, perms).count() == 4


def test_secured_rows(spark):
    rows = spark.createDataFrame([("sales", 1), ("sales_eu", 2), ("hr", 3)], "ds string, n int")
    groups = spark.createDataFrame(GROUPS, "group string, role string")
    perms = spark.createDataFrame(PERMISSIONS, "role string, resource_type string, name_pattern string, action string")
    assert {r["n"] for r in A.secured(rows, "ds", "team-a", groups, perms).collect()} == {1, 2}
    assert {r["n"] for r in A.secured(rows, "ds", '["admins"]', groups, perms).collect()} == {1, 2, 3}
    assert A.secured(rows, "ds", "nobody", groups, perms).count() == 0


def test_thousands_of_permissions(spark):
    rows = spark.createDataFrame([(f"set{i}", i) for i in range(50)], "ds string, n int")
    groups = spark.createDataFrame([("team", "r"), ("other", "s")], "group string, role string")
    perms = [("r", "DATASOURCE", f"set{i * 7}", "READ") for i in range(5_000)] + [("r", "DATASOURCE", "set4[89]", "READ")]
    perms += [("s", "DATASOURCE", ".*", "READ"), ("r", "DATASOURCE", "set1", "WRITE")]
    table = spark.createDataFrame(perms, "role string, resource_type string, name_pattern string, action string")
    assert {r["n"] for r in A.secured(rows, "ds", "team", groups, table).collect()} == {0, 7, 14, 21, 28, 35, 42, 48, 49}
    assert A.secured(rows, "ds", "other", groups, table).count() == 50


def test_decisions_keep_no_rows_for_a_role_and_a_resource(spark):
    requests = spark.createDataFrame(
        [("p", True, "team", "STATE", f"n{i}", "READ") for i in range(40)],
        "principal string, has_context boolean, claim string, resource_type string, resource_name string, action string")
    groups = spark.createDataFrame([("team", f"r{i}") for i in range(30)], "group string, role string")
    perms = spark.createDataFrame(
        [(f"r{i}", "STATE", ".*", "READ") for i in range(30)], "role string, resource_type string, name_pattern string, action string")
    done = A.granted(requests, groups, perms)
    assert done.count() == 40
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert "role" not in plan.split("Relation")[0].split("Aggregate")[1]


def test_mapping_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "k string, v string")
    new = spark.createDataFrame([("b", "2"), ("c", "4"), ("d", "5")], "k string, v string")
    got = {r["k"]: (r["v"], r["change"]) for r in S.minimal_changes(old, new, ["k"]).collect()}
    assert got == {"a": ("1", "delete"), "b": ("2", "keep"), "c": ("4", "update"), "d": ("5", "create")}
    replaced = S.replace_changes(old, new).groupBy("change").count().collect()
    assert {r["change"]: r["count"] for r in replaced} == {"delete": 3, "create": 3}
    # both change sets end in the desired table
    final = S.minimal_changes(old, new, ["k"]).where("change <> 'delete'").drop("change")
    assert sorted(map(tuple, final.collect())) == sorted(map(tuple, new.collect()))


def test_array_sets(spark):
    a, b = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("z"), F.lit("x"), F.lit("z"))
    assert spark.range(1).select(S.ordered_distinct(a, b).alias("v")).first()["v"] == ["x", "y", "z"]
