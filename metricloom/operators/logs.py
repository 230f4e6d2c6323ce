"""Log pipelines: file choice, long lines, partial lines, body merge, routing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metricloom.functions import parsers as P
from metricloom.operators.prefix import running

LONG_LINE = 32 * 1024
# lines that are joined in one row
MESSAGE_PARTS = 100_000

# Collected paths and their stream names; {..} are deployment names.
COLLECT_LIST = (
    ("{agent_log}", "{component}/{instance}{agent_log}"),
    ("/var/log/cloud-init-output.log", "{component}/{instance}/var/log/cloud-init-output.log"),
    ("/var/log/messages", "{component}/{instance}/var/log/messages"),
    ("/var/log/supervisor/**.log", "{component}/{instance}/var/log/supervisor/supervisord.log"),
    ("/var/log/audit/audit.log", "{component}/{instance}/var/log/audit/audit.log"),
    ("{home}/log/coordinator.log", "{component}/{instance}{home}/log/coordinator.log"),
    ("{home}/log/overlord.log", "{component}/{instance}{home}/log/overlord.log"),
    ("{home}/log/router.log", "{component}/{instance}{home}/log/router.log"),
    ("{home}/log/broker.log", "{component}/{instance}{home}/log/broker.log"),
    ("{home}/log/middleManager.log", "{component}/{instance}{home}/log/middleManager.log"),
    ("{home}/log/indexer/**.log", "{component}/{instance}{home}/indexer/logs"),
    ("{home}/log/historical.log", "{component}/{instance}{home}/log/historical.log"),
    ("{coordination_home}/logs/zookeeper.log", "zookeeper/{instance}{coordination_home}/logs/zookeeper.log"),
    ("{home}/log/ssm_automation.log", "{component}/{instance}{home}/log/ssm_automation.log"),
)
# Units kept from the journal, and its renamed fields.
JOURNAL_UNITS = ("docker.service", "kubelet.service")
JOURNAL_FIELDS = {"_HOSTNAME": "hostname", "_SYSTEMD_UNIT": "systemd_unit", "MESSAGE": "message"}


@dataclass(frozen=True, kw_only=True)
class LogLayout:
    """Where a deployment keeps its logs and how it names their destinations."""

    cluster: str
    group_root: str
    home: str
    coordination_home: str
    agent_log: str
    containers: str
    # workloads left out of the application logs, and those read again on their own
    excluded: tuple[str, ...]
    readmitted: tuple[str, ...]
    data_plane: tuple[str, ...]

    @property
    def group(self) -> str:
        return f"{self.group_root}/{self.cluster}"

    def globs(self, names) -> list[str]:
        return [f"{self.containers}/{name}*" for name in names]

    def routes(self) -> list[tuple[str, str]]:
        names = {"agent_log": self.agent_log, "home": self.home, "coordination_home": self.coordination_home,
                 "component": "{component}", "instance": "{instance}"}
        return [(path.format(**names), stream.format(**names)) for path, stream in COLLECT_LIST]


def application_files(lines: DataFrame, layout: LogLayout, path: str = "path") -> DataFrame:
    """Container logs minus the excluded workloads, plus the re-admitted ones."""
    at = F.col(path)
    every = at.rlike(P.glob_pattern(f"{layout.containers}/*.log"))
    left_out = P.matches_any_glob(at, layout.globs(layout.excluded))
    again = P.matches_any_glob(at, layout.globs(layout.readmitted))
    return lines.where((every & ~left_out) | again)


def data_plane_files(lines: DataFrame, layout: LogLayout, path: str = "path") -> DataFrame:
    return lines.where(P.matches_any_glob(F.col(path), layout.globs(layout.data_plane)))


def journal(records: DataFrame) -> DataFrame:
    """Records of the two kept units, with the three kept fields renamed."""
    kept = records.where(F.col("_SYSTEMD_UNIT").isin(*JOURNAL_UNITS))
    return kept.select(*[F.col(old).alias(new) for old, new in JOURNAL_FIELDS.items()])


def skip_long_lines(lines: DataFrame, column: str = "value", limit: int = LONG_LINE) -> DataFrame:
    """Lines of more bytes are skipped whole, never cut."""
    return lines.where(F.octet_length(column) <= limit)


def parsed(lines: DataFrame, parser, column: str = "value", keep_unmatched: bool = False) -> DataFrame:
    """The parser's fields as columns; lines it does not match are left out or get null fields."""
    fields = parser(F.col(column))
    return lines.select(*lines.columns, F.inline_outer(fields) if keep_unmatched else F.inline(fields))


def merge_json_body(lines: DataFrame, column: str = "log", keep_log: bool = True) -> DataFrame:
    """Add ``log_processed``, the top-level fields as text, where the body is a JSON object."""
    fields = F.try_variant_get(F.try_parse_json(F.col(column)), "$", "map<string,string>")
    merged = lines.withColumn("log_processed", fields)
    return merged if keep_log else merged.drop(column)


def join_partial_lines(lines: DataFrame, keys: list[str], order: str, block: Column, flag: str = "logtag",
                       text: str = "log", coarser=None, most_parts: int = MESSAGE_PARTS) -> DataFrame:
    """Concatenate P* F runs per stream; a run with no closing F has ``complete = false``.

    The run number is a running count of closing flags over blocks of the stream, so a stream
    with a third of all lines is scanned by many tasks; ``block`` never decreases along ``order``.
    Only the lines of one message meet. One of more than ``most_parts`` lines, as a stream that
    never closes one makes, comes in pieces of at most so many: ``piece`` is 0 for a whole message and
    counts from 1 otherwise. No line is left out.
    """
    closed = F.when(F.col(flag) == "F", 1).otherwise(0).cast("bigint")
    sums = {"message_no": closed, "__line": F.lit(1).cast("bigint")}
    numbered = running(lines, keys, [order], block, sums, inclusive=False, coarser=coarser)
    message = [*keys, "message_no"]
    cuts = numbered.groupBy(*message, F.floor(F.col("__line") / most_parts).alias("__cut")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(text).alias("text")))).alias("__parts"),
        F.max(F.col(flag) == "F").alias("complete"),
        F.min(order).alias("first"),
    )
    whole = W.partitionBy(*message)
    held = cuts.withColumns({"__n": F.sum(F.size("__parts")).over(whole), "__low": F.min("__cut").over(whole)})
    piece = F.when(F.col("__n") <= most_parts, 0).otherwise(F.col("__cut") - F.col("__low") + 1).cast("bigint")
    # a message of no more than most_parts lines lies in two cuts at most
    pieces = held.groupBy(*message, piece.alias("piece")).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__cut", "__parts"))), lambda c: c["__parts"])).alias("__parts"),
        F.max("complete").alias("complete"), F.min("first").alias("first"))
    joined = F.array_join(F.transform("__parts", lambda p: p["text"]), "")
    return pieces.select(
        *message, "first", joined.alias("message"),
        F.size("__parts").cast("bigint").alias("parts"), "complete", "piece",
    )


def route(lines: DataFrame, layout: LogLayout, component: Column, instance: Column, path: str = "path") -> DataFrame:
    """Add ``log_group`` and ``log_stream`` of the first matching route, null where none does.

    The list is short and constant, so it is one CASE expression with compiled patterns.
    """
    number, stream = F, F
    for i, (glob, template) in enumerate(layout.routes(), start=1):
        hit = F.col(path).rlike(P.glob_pattern(glob))
        name = F.replace(F.replace(F.lit(template), F.lit("{component}"), component), F.lit("{instance}"), instance)
        number, stream = number.when(hit, F.lit(i)), stream.when(hit, name)
    return lines.withColumns({
        "route_no": number,
        "log_group": F.when(number.isNotNull(), F.lit(layout.group)),
        "log_stream": stream,
    })


def sink_route(lines: DataFrame, layout: LogLayout, host: Column, tag: str = "tag") -> DataFrame:
    """Log group per cluster and stream prefix per tag family."""
    family = F.split_part(F.col(tag), F.lit("."), F.lit(1))
    own_host = family.isin("application", "dataplane", "host")
    prefix = F.when(own_host, F.concat(family, F.lit("-"), host, F.lit("-"))).when(
        family == "kube", F.lit("from-fluent-bit-")
    )
    return lines.withColumns({
        "log_group": F.when(prefix.isNotNull(), F.lit(layout.group)),
        "stream_prefix": prefix,
        "log_stream": F.concat(prefix, F.col(tag)),
    })
