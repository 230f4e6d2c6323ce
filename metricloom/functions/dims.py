"""Dimension bags: ``array<struct<name,str,list,other>>`` in, ``array<struct<name,value>>`` out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metricloom.catalog import BLOCKED_DIMS

RAW_DIMS = "array<struct<name:string,str:string,list:array<string>,other:string>>"
CLEAN_DIMS = "array<struct<name:string,value:string>>"


# white space and brackets vanish, a colon becomes a dash; then control characters are trimmed
DELETED = "[] \t\n\x0b\f\r"
CONTROL = "".join(map(chr, range(0x21)))


def scrub(value: Column) -> Column:
    """Drop brackets and white space, turn ``:`` into ``-``, trim control characters."""
    return F.btrim(F.translate(value, ":" + DELETED, "-"), F.lit(CONTROL))


def typed_value(dim: Column) -> Column:
    """A string, or the only string of a one-element list; every other type becomes null."""
    return F.coalesce(dim["str"], F.when(F.size(dim["list"]) == 1, dim["list"][0]))


def clean_dims(dims: Column, blocked=BLOCKED_DIMS) -> Column:
    kept = F.filter(dims, lambda d: ~d["name"].isin(*blocked))
    typed = F.transform(
        kept, lambda d: F.struct(d["name"].alias("name"), scrub(typed_value(d)).alias("value"))
    )
    return F.filter(typed, lambda d: F.length(d["value"]) > 0)


def dim(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), value.alias("value"))


def dim_value(dims: Column, name: str) -> Column:
    """First value stored under ``name``, null if there is none."""
    return F.get(F.filter(dims, lambda d: d["name"] == name), F.lit(0))["value"]


def project_dims(dims: Column, names: Column) -> Column:
    return F.filter(dims, lambda d: F.array_contains(names, d["name"]))


def series_id(dims: Column) -> Column:
    """Name-sorted JSON text of the dimensions; duplicates are kept."""
    return F.to_json(F.array_sort(dims))


def has_dim(dims: Column, name: str, value: str) -> Column:
    return F.exists(dims, lambda d: (d["name"] == name) & (d["value"] == value))


def matches_dims(dims: Column, wanted: dict, match: str = "exact") -> Column:
    """``exact``: the same names and values and nothing else; ``subset``: at least these."""
    condition = F.lit(True)
    for name, value in wanted.items():
        condition &= has_dim(dims, name, value)
    if match == "exact":
        condition &= F.size(dims) == len(wanted)
    elif match != "subset":
        raise ValueError(f"match must be exact or subset, not {match!r}")
    return condition
