"""Log line parsers.

A parser turns a line into an array of one struct, or an empty one where the line does not
match. ``inline`` then yields the fields while evaluating every pattern once per line; a struct
column filtered afterwards would repeat them in the filter and in each field.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The line patterns.
SYSLOG = (
    r"^([^ ]* {1,2}[^ ]* [^ ]*) ([^ ]*) ([a-zA-Z0-9_\/\.\-]*)(?:\[([0-9]+)\])?(?:[^\:]*\:)? *(.*)$"
)
CONTAINER_FIRST_LINE = (
    r'((?<="log":")\S(?!\.).*?)(?<!\\)".*((?<="stream":").*?)"'
    r'.*(\d{4}-\d{1,2}-\d{1,2}T\d{2}:\d{2}:\d{2}\.\w*).*(?=\})'
)
AGENT_FIRST_LINE = (
    r'((?<="log":")\d{4}[\/-]\d{1,2}[\/-]\d{1,2}[ T]\d{2}:\d{2}:\d{2}(?!\.).*?)(?<!\\)"'
    r'.*((?<="stream":").*?)".*(\d{4}-\d{1,2}-\d{1,2}T\d{2}:\d{2}:\d{2}\.\w*).*(?=\})'
)
CRI_TIME = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX"
SYSLOG_TIME = "yyyy MMM d HH:mm:ss"


def _parse(line: Column, pattern: str, names: dict[str, int]) -> Column:
    fields = F.struct(*[F.regexp_extract(line, pattern, group).alias(name) for name, group in names.items()])
    none = F.array().cast(f"array<struct<{','.join(f'{name}:string' for name in names)}>>")
    return F.when(line.rlike(pattern), F.array(fields)).otherwise(none)


def parse_cri(line: Column) -> Column:
    """Time, stream, partial flag and body, the four space-separated parts of a container line.

    Split in one pass; the body keeps its own spaces.
    """
    parts = F.filter(
        F.array(F.split(line, " ", 4)),
        lambda w: (F.size(w) == 4) & (w[0] != "") & w[1].isin("stdout", "stderr") & w[2].isin("P", "F"),
    )
    return F.transform(parts, lambda w: F.struct(
        w[0].alias("time"), w[1].alias("stream"), w[2].alias("logtag"), w[3].alias("log")))


def cri_time(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit(CRI_TIME))


def parse_syslog(line: Column) -> Column:
    return _parse(line, SYSLOG, {"time": 1, "host": 2, "ident": 3, "pid": 4, "message": 5})


def syslog_time(text: Column, year: int) -> Column:
    """The line carries no year, so the caller names it."""
    single_spaced = F.regexp_replace(text, " +", " ")
    return F.try_to_timestamp(F.concat(F.lit(f"{year} "), single_spaced), F.lit(SYSLOG_TIME))


def parse_container_first_line(line: Column) -> Column:
    return _parse(line, CONTAINER_FIRST_LINE, {"log": 1, "stream": 2, "time": 3})


def parse_agent_first_line(line: Column) -> Column:
    return _parse(line, AGENT_FIRST_LINE, {"log": 1, "stream": 2, "time": 3})


def glob_pattern(glob: str) -> str:
    """A regular expression matching the whole path; ``**`` also crosses folders."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        char = glob[i]
        out += "[^/]*" if char == "*" else "\\" + char if char in ".+()[]{}^$|?\\" else char
        i += 1
    return rf"\A{out}\z"


def matches_any_glob(path: Column, globs) -> Column:
    found = F.lit(False)
    for glob in globs:
        found |= path.rlike(glob_pattern(glob))
    return found
