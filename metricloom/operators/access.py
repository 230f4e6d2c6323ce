"""Bulk access decisions: claim to groups to roles to permissions to allow or deny."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.session import settle, stored

RESOURCE = ["resource_type", "resource_name", "action"]
PATTERN_SIGNS = r"[\\.\[\](){}*+?^$|]"
EVERY = ".*"


def claim_groups(claim: Column) -> Column:
    """A JSON array of strings is used as is; anything else is split on commas and trimmed."""
    json = F.try_parse_json(claim)
    is_list = F.schema_of_variant(json).isin("ARRAY<STRING>", "ARRAY<VOID>")
    listed = F.from_json(claim, "array<string>")
    # trailing commas add no empty groups, a lone empty text is one empty group
    text = F.regexp_replace(claim, ",+$", "")
    split = F.when((text == "") & (claim != ""), F.array().cast("array<string>")).otherwise(
        F.transform(F.split(text, ","), lambda g: F.trim(g))
    )
    return F.when(is_list, listed).otherwise(split)


def full_match(name: Column, pattern: Column) -> Column:
    return F.rlike(name, F.concat(F.lit(r"\A(?:"), pattern, F.lit(r")\z")))


def claim_roles(claims: DataFrame, group_roles: DataFrame) -> DataFrame:
    """Distinct (claim, role): claimed groups equal to a stored group, then its roles."""
    groups = claims.select("claim").where("claim IS NOT NULL").distinct().select(
        "claim", F.explode(F.array_distinct(claim_groups(F.col("claim")))).alias("group")
    )
    return groups.join(group_roles, "group").select("claim", "role").distinct()


def permissions(principals: DataFrame, group_roles: DataFrame, role_permissions: DataFrame) -> DataFrame:
    """Bag of permissions per principal: one row per matched group, role and permission."""
    groups = principals.select(
        "principal", F.explode(F.array_distinct(claim_groups(F.col("claim")))).alias("group")
    )
    return groups.join(group_roles, "group").join(role_permissions, "role")


def allowed_resources(resources: DataFrame, role_permissions: DataFrame) -> DataFrame:
    """Distinct (role, resource) some permission of the role matches; the result itself is roles x resources.

    A permission for every name joins on type and action alone, a plain name on the name too. Only
    real patterns are tried, once per distinct resource however many requests name it.
    """
    asked = resources.select(*RESOURCE).distinct()
    kinds = [asked.join(part, keys) for part, keys in (
        (every_name(role_permissions), ["resource_type", "action"]), (plain_names(role_permissions), RESOURCE))]
    matched = asked.join(patterns(role_permissions), ["resource_type", "action"]).where(
        full_match(F.col("resource_name"), F.col("name_pattern")))
    return reduce(DataFrame.union, [part.select("role", *RESOURCE) for part in (*kinds, matched)]).distinct()


def every_name(role_permissions: DataFrame) -> DataFrame:
    return role_permissions.where(F.col("name_pattern") == EVERY).select("role", "resource_type", "action").distinct()


def plain_names(role_permissions: DataFrame) -> DataFrame:
    plain = role_permissions.where(~F.col("name_pattern").rlike(PATTERN_SIGNS))
    return plain.withColumnRenamed("name_pattern", "resource_name").select("role", *RESOURCE).distinct()


def patterns(role_permissions: DataFrame) -> DataFrame:
    real = F.col("name_pattern").rlike(PATTERN_SIGNS) & (F.col("name_pattern") != EVERY)
    return role_permissions.where(real).select("role", "resource_type", "action", "name_pattern").distinct()


def granted(requests: DataFrame, group_roles: DataFrame, role_permissions: DataFrame) -> DataFrame:
    """Distinct (claim, resource, action) some permission allows.

    Requests are reduced to their distinct combinations before any join, so a claim or a resource
    holding a third of the requests costs one row. A claim that may use every name of a type needs no
    names at all; plain names meet by equality, and what is left is tried against the claim's own
    patterns: nothing is kept for a role and a resource.
    """
    asked = stored(requests.where("claim IS NOT NULL").select("claim", *RESOURCE).distinct(), "asked")
    roles = stored(claim_roles(asked, group_roles), "claim-roles")
    held = lambda part: roles.join(part, "role").drop("role").distinct()
    every = asked.join(held(every_name(role_permissions)), ["claim", "resource_type", "action"], "left_semi")
    named = asked.join(held(plain_names(role_permissions)), ["claim", *RESOURCE], "left_semi")
    own = held(patterns(role_permissions)).withColumnsRenamed({"claim": "c", "resource_type": "t", "action": "a"})
    same = (F.col("claim") == F.col("c")) & (F.col("resource_type") == F.col("t")) & (F.col("action") == F.col("a"))
    matched = asked.join(own, same & full_match(F.col("resource_name"), F.col("name_pattern")), "left_semi")
    return every.unionByName(named).unionByName(matched).distinct()


def authorise(requests: DataFrame, group_roles: DataFrame, role_permissions: DataFrame,
              claim_configured: bool = True) -> DataFrame:
    """Add ``allowed`` and ``reason`` to every request.

    ``requests`` has ``principal``, ``has_context``, ``claim``, ``resource_type``,
    ``resource_name`` and ``action``.
    """
    known = F.col("principal").isNotNull() & F.coalesce("has_context", F.lit(False))
    if not claim_configured:
        return requests.withColumns({
            "allowed": known,
            "reason": F.when(F.col("principal").isNull(), "no principal")
            .when(~known, "no context").otherwise("no claim configured"),
        })
    # settled, so a small decision table is broadcast and the requests are not shuffled
    yes = settle(granted(requests.where(known), group_roles, role_permissions), "granted")
    joined = requests.join(yes.withColumn("__granted", F.lit(True)), ["claim", *RESOURCE], "left")
    reason = (
        F.when(F.col("principal").isNull(), "no principal")
        .when(~known, "no context")
        .when(F.col("claim").isNull(), "no claim")
        .when(F.col("__granted"), "permission")
        .otherwise("no permission")
    )
    return joined.withColumn("reason", reason).withColumn(
        "allowed", F.col("reason") == "permission"
    ).select(*requests.columns, "allowed", "reason")


def visible_datasets(rows: DataFrame, dataset: str, claims: DataFrame, group_roles: DataFrame,
                     role_permissions: DataFrame, action: str = "READ") -> DataFrame:
    """Distinct (claim, data set) of the data sets in ``rows`` each claim may use."""
    names = rows.select(F.lit("DATASOURCE").alias("resource_type"), F.col(dataset).alias("resource_name"),
                        F.lit(action).alias("action")).distinct()
    usable = allowed_resources(stored(names, "datasets"), role_permissions)
    return claim_roles(claims, group_roles).join(usable, "role").select(
        "claim", F.col("resource_name").alias(dataset)).distinct()


def secured(rows: DataFrame, dataset: str, claim: str, group_roles: DataFrame,
            role_permissions: DataFrame) -> DataFrame:
    """The rows one claim may read: a semi join on its data sets. Permissions are a table of any size."""
    claims = rows.sparkSession.range(1).select(F.lit(claim).alias("claim"))
    return rows.join(visible_datasets(rows, dataset, claims, group_roles, role_permissions), dataset, "left_semi")
