import dataclasses
import json

import pytest
from pyspark.sql import functions as F

from metricloom.functions import parsers as P
from metricloom.operators import coordination as C
from metricloom.operators import logs as L
from metricloom.plans.logs import LAYOUT
from metricloom.sources import text


def lines(spark, values, column="value"):
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


def test_container_lines(spark):
    rows = lines(spark, [
        "2024-01-01T00:00:00.123456789Z stdout F two  spaces kept ", "2024-01-01T00:00:00Z stderr P ",
        "2024-01-01T00:00:00Z stdlog F x", "2024-01-01T00:00:00Z stdout X y", "short", " stdout F x",
        "2024-01-01T00:00:00.5+02:00 stdout F",
    ])
    got = [tuple(r)[1:] for r in L.parsed(rows, P.parse_cri).collect()]
    assert got == [("2024-01-01T00:00:00.123456789Z", "stdout", "F", "two  spaces kept "),
                   ("2024-01-01T00:00:00Z", "stderr", "P", "")]
    kept = L.parsed(rows, P.parse_cri, keep_unmatched=True)
    assert kept.count() == 7 and kept.where("log IS NULL").count() == 5


def test_container_time(spark):
    rows = lines(spark, ["2024-01-01T00:00:00.123456789Z", "2024-01-01T02:00:00.5+02:00", "2024-01-01T00:00:00Z", "x"])
    got = [r[0] for r in rows.select(F.unix_micros(P.cri_time(F.col("value")))).collect()]
    base = 1704067200_000000
    assert got == [base + 123456, base + 500000, base, None]


def test_syslog(spark):
    rows = lines(spark, ["Feb  9 03:04:05 host-1 sshd[77]: hello: there", "Feb 29 03:04:05 h cron: run", "nope"])
    got = L.parsed(rows, P.parse_syslog).select(
        "host", "ident", "pid", "message", P.syslog_time(F.col("time"), 2024).cast("string").alias("at")).collect()
    assert [tuple(r) for r in got] == [
        ("host-1", "sshd", "77", "hello: there", "2024-02-09 03:04:05"), ("h", "cron", "", "run", "2024-02-29 03:04:05")]


def test_first_lines(spark):
    line = '{"log":"start of it","stream":"stderr","time":"2024-01-01T00:00:00.123Z"}'
    dated = '{"log":"2024/01/02 03:04:05 go","stream":"stdout","time":"2024-01-01T00:00:00.123Z"}'
    got = L.parsed(lines(spark, [line, dated]), P.parse_container_first_line).collect()
    assert [r["log"] for r in got] == ["start of it", "2024/01/02 03:04:05 go"]
    assert (got[0]["stream"], got[0]["time"]) == ("stderr", "2024-01-01T00:00:00.123Z")
    assert [r["log"] for r in L.parsed(lines(spark, [line, dated]), P.parse_agent_first_line).collect()] == [
        "2024/01/02 03:04:05 go"]


def test_json_merge(spark):
    rows = lines(spark, ['{"a":1,"b":"x"}', "plain", "[1]", '{"a":'], "log")
    got = [r["log_processed"] for r in L.merge_json_body(rows).collect()]
    assert got == [{"a": "1", "b": "x"}, None, None, None]
    assert "log" not in L.merge_json_body(rows, keep_log=False).columns


def test_long_lines_are_skipped_whole(spark):
    rows = lines(spark, ["x" * 10, "y" * 11])
    assert [r["value"] for r in L.skip_long_lines(rows, limit=10).collect()] == ["x" * 10]


@pytest.mark.parametrize("glob, path, hit", [
    ("/a/*.log", "/a/b.log", True), ("/a/*.log", "/a/b/c.log", False), ("/a/**.log", "/a/b/c.log", True),
    ("/a/b*", "/a/bcd", True), ("/a/b.log", "/a/bxlog", False), ("/a/*.log", "/a/b.log.1", False),
])
def test_globs(spark, glob, path, hit):
    assert spark.range(1).select(F.lit(path).rlike(P.glob_pattern(glob))).first()[0] is hit


def iter_nodes(plan, name):
    if plan.nodeName().startswith(name):
        yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from iter_nodes(children.apply(i), name)


def test_file_sources(spark, tmp_path):
    layout = dataclasses.replace(LAYOUT, containers=f"{tmp_path}/containers")
    folder = tmp_path / "containers"
    folder.mkdir()
    for name in ("web-1", "metric-agent-1", "fluent-bit-2", "network-node-3", "kube-proxy-4"):
        (folder / f"{name}.log").write_text(f"{name}\n")
    (folder / "web.txt").write_text("not a log\n")
    assert {r["value"] for r in text.container_logs(spark, layout).collect()} == {"web-1", "metric-agent-1", "fluent-bit-2"}
    chosen = text.data_plane_logs(spark, layout)
    assert {r["value"] for r in chosen.collect()} == {"network-node-3", "kube-proxy-4"}
    # the other files are not even opened
    scan = next(iter_nodes(chosen._jdf.queryExecution().executedPlan(), "Scan"))
    assert scan.metrics().apply("numFiles").value() == 2


def test_journal_and_host_sources(spark, tmp_path):
    records = [{"_HOSTNAME": "h", "_SYSTEMD_UNIT": unit, "MESSAGE": "m", "_PID": "1"}
               for unit in ("docker.service", "kubelet.service", "sshd.service")]
    (tmp_path / "journal.json").write_text("\n".join(json.dumps(r) for r in records))
    kept = text.journal_records(spark, f"{tmp_path}/journal.json")
    assert kept.columns == ["hostname", "systemd_unit", "message"] and kept.count() == 2
    (tmp_path / "dmesg").write_text("[0.0] boot\n")
    (tmp_path / "messages").write_text("Jan  1 00:00:01 h unit: one\nbroken\n")
    (tmp_path / "secure").write_text("Jan  1 00:00:02 h sshd[5]: two\n")
    got = text.host_logs(spark, f"{tmp_path}/dmesg", f"{tmp_path}/messages", f"{tmp_path}/secure", P.parse_syslog)
    assert {(r["tag"], r["message"], r["pid"]) for r in got.collect()} == {
        ("host.dmesg", "[0.0] boot", None), ("host.messages", "one", ""), ("host.secure", "two", "5")}


def test_collect_list(spark, tmp_path):
    for path in ("/var/log/messages", "/var/log/supervisor/a/b.log", "/srv/engine/log/indexer/t.log", "/var/log/other"):
        target = tmp_path / path.lstrip("/")
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text("x\n")
    got = text.collected_logs(spark, str(tmp_path), LAYOUT, "broker", "i-1")
    assert {(r["path"], r["log_stream"]) for r in got.collect()} == {
        ("/var/log/messages", "broker/i-1/var/log/messages"),
        ("/var/log/supervisor/a/b.log", "broker/i-1/var/log/supervisor/supervisord.log"),
        ("/srv/engine/log/indexer/t.log", "broker/i-1/srv/engine/indexer/logs")}
    assert {r["log_group"] for r in got.collect()} == {"/metricloom/cluster-a"}
    assert len(LAYOUT.routes()) == 14


def test_scrapes(spark):
    values = ["zk_version\t3.8", "", "   ", "zk_avg_latency\t1", "zk_max_latency  7 ms", "zk_unknown 3", "zk_packets_sent",
              "zk_avg_latency 2", "zk_server_state\tleader"]
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "node int, at int, value string")
    got = C.scrape_values(rows, ["node"], "at")
    assert {(r["metric"], r["text"]) for r in got.collect()} == {
        ("zk_avg_latency", "2"), ("zk_max_latency", "7"), ("zk_server_state", "leader")}
    datums = {r["name"]: r for r in C.coordination_datums(got, "node").collect()}
    assert (datums["zk_leader"]["number"], datums["zk_leader"]["unit"], len(datums["zk_leader"]["dims"])) == (3.0, "None", 2)
    assert datums["zk_avg_latency"]["dims"][2]["value"] == "1" and datums["zk_max_latency"]["number"] == 7.0
    follower = got.where("metric = 'zk_server_state'").withColumn("text", F.lit("follower"))
    assert C.coordination_datums(follower, "node").count() == 0
