"""Access review over roles and requests (J8, U1, W7 wrapper)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.monitoring import not_expired


def role_permissions(roles: DataFrame) -> DataFrame:
    """explode ``roles(role, permissions array<string>)`` with entries
    ``resource:action[:condition...]`` (``*`` wildcards; conditions
    ``same_org`` and ``owner_only``) into rows. F17 slice: what follows the
    first two parts are the conditions."""
    parts = F.split("p", ":")
    conditions = F.slice(F.col("parts"), 3, F.greatest(F.size("parts") - 2, F.lit(0)))
    return (roles.select("role", F.explode("permissions").alias("p"))
            .select("role", parts.alias("parts"))
            .select("role", F.col("parts")[0].alias("resource"),
                    F.get("parts", F.lit(1)).alias("action"),
                    F.array_contains(conditions, "same_org").alias("same_org"),
                    F.array_contains(conditions, "owner_only").alias("owner_only")))


def active_roles(user_roles: DataFrame, as_of=None) -> DataFrame:
    """Roles that are switched on and, at ``as_of``, not expired."""
    ur = user_roles.where(F.col("is_active"))
    return ur if as_of is None else ur.where(not_expired(as_of))


def user_permissions(user_roles: DataFrame, roles: DataFrame, as_of=None) -> DataFrame:
    """Set union of the permissions of a user's active, unexpired roles."""
    return (active_roles(user_roles, as_of).join(role_permissions(roles), "role")
            .select("user_id", "resource", "action").distinct())


def check_requests(requests: DataFrame, user_roles: DataFrame, roles: DataFrame,
                   as_of=None) -> DataFrame:
    """Each request ``(request_id, user_id, resource, action)`` is
    allowed when one of the user's active, unexpired roles grants
    ``resource`` or ``*`` and ``action`` or ``*``, and the grant's conditions
    hold: ``same_org`` - the request's ``organization_id`` is the role's
    (``user_roles.organization_id``) or unknown; ``owner_only`` - its
    ``owner_id`` is the user or unknown.

    The wildcard theta condition becomes an equi-join: every request is
    expanded into its four (resource|*, action|*) forms, joined to the
    exploded grants, and conditions are tested on the matches."""
    ur = active_roles(user_roles, as_of)
    org = F.col("organization_id") if "organization_id" in ur.columns else \
        F.lit(None).cast("string")
    perms = (ur.select("user_id", "role", org.alias("g_org")).join(role_permissions(roles), "role")
             .select("user_id", F.col("resource").alias("g_res"), F.col("action").alias("g_act"),
                     "g_org", "same_org", "owner_only").distinct())
    has = set(requests.columns)
    r_org = F.col("organization_id") if "organization_id" in has else F.lit(None).cast("string")
    r_owner = F.col("owner_id") if "owner_id" in has else F.lit(None).cast("long")
    forms = requests.select(
        "request_id", "user_id", r_org.alias("r_org"), r_owner.alias("r_owner"),
        F.explode(F.array(
            F.struct(F.col("resource").alias("g_res"), F.col("action").alias("g_act")),
            F.struct(F.lit("*").alias("g_res"), F.col("action").alias("g_act")),
            F.struct(F.col("resource").alias("g_res"), F.lit("*").alias("g_act")),
            F.struct(F.lit("*").alias("g_res"), F.lit("*").alias("g_act")))).alias("f"))
    true = F.lit(True)
    in_org = ~F.col("same_org") | F.coalesce(F.col("r_org") == F.col("g_org"), true)
    owner = ~F.col("owner_only") | F.coalesce(F.col("r_owner") == F.col("user_id"), true)
    granted = (forms.select("request_id", "user_id", "r_org", "r_owner", "f.*")
               .join(perms, ["user_id", "g_res", "g_act"]).where(in_org & owner)
               .select("request_id").distinct().withColumn("allowed", true))
    return (requests.join(granted, "request_id", "left")
            .withColumn("allowed", F.coalesce("allowed", F.lit(False))))
