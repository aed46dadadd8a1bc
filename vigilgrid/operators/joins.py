"""Equi, semi and anti joins of the domain.

No side is force-broadcast: Spark's own size threshold and its adaptive runtime sizes decide, and
skewed keys are split by adaptive skew handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from vigilgrid.operators.filters import for_tenant

# What each role may do.
ROLE_GRANTS = {
    "super_admin": ["camera_read", "camera_write", "video_export", "alert_manage", "query_execute", "system_admin"],
    "org_admin": ["camera_read", "camera_write", "video_export", "alert_manage", "query_execute"],
    "operator": ["camera_read", "alert_manage"],
    "analyst": ["camera_read", "video_export", "query_execute"],
    "viewer": ["camera_read"],
}


def attach_camera(hits: DataFrame, segments: DataFrame) -> DataFrame:
    """Fill missing ``camera_id`` of hits from their segment."""
    known = segments.select("segment_id", F.col("camera_id").alias("_segment_camera"))
    return hits.join(known, "segment_id", "left").withColumn(
        "camera_id", F.coalesce("camera_id", "_segment_camera")).drop("_segment_camera")


def on_allowed_cameras(rows: DataFrame, segments: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows whose segment lies on an allowed camera; an empty list allows nothing."""
    ok = segments.join(allowed.select("camera_id"), "camera_id", "left_semi").select("segment_id")
    return rows.join(ok, "segment_id", "left_semi")


def camera_scopes(users: DataFrame, cameras: DataFrame, assignments: DataFrame) -> DataFrame:
    """What each user may see, without listing cameras a rule already covers.

    One row per user with scope ``all`` (super admin) or ``org``; operators get one ``camera`` row
    per assigned camera of their own organisation, and none when nothing is assigned.
    """
    ruled = users.where(F.col("role") != "operator").select(
        "user_id", F.when(F.col("role") == "super_admin", "all").otherwise("org").alias("scope"),
        F.when(F.col("role") != "super_admin", F.col("org_id")).alias("org_id"),
        F.lit(None).cast("long").alias("camera_id"))
    bound = (users.where(F.col("role") == "operator").select("user_id", "org_id")
             .join(assignments.select("user_id", "camera_id").distinct(), "user_id")
             .join(cameras.select("camera_id", "org_id"), ["camera_id", "org_id"], "left_semi")
             .select("user_id", F.lit("camera").alias("scope"), "org_id", "camera_id"))
    return ruled.unionByName(bound)


def allowed_cameras(cameras: DataFrame, assignments: DataFrame, user_id, org, role: str) -> DataFrame:
    """Cameras one user may search."""
    if role == "super_admin":
        return cameras.select("camera_id")
    own = for_tenant(cameras, org).select("camera_id")
    if role != "operator":
        return own
    return own.join(assignments.where(F.col("user_id") == F.lit(user_id)), "camera_id", "left_semi")


def effective_permissions(users: DataFrame, user_roles: DataFrame, role_permissions: DataFrame,
                          permissions: DataFrame) -> DataFrame:
    return (users.select("user_id").join(user_roles, "user_id").join(role_permissions, "role_id")
            .join(permissions, "permission_id").select("user_id", "permission").distinct())


def role_grants(df: DataFrame, role: str) -> DataFrame:
    """Add the ``permission`` rows of each row's role from the fixed matrix."""
    grants = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(p).alias("p"))
                       for r, ps in ROLE_GRANTS.items() for p in ps])
    return df.withColumn("_g", F.explode(F.filter(grants, lambda g: g["r"] == F.col(role)))).withColumn(
        "permission", F.col("_g.p")).drop("_g")


def prefer(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """``primary`` unless it is empty, else ``fallback``, decided inside the plan."""
    found = primary.limit(1).select(F.lit(1).alias("_found"))
    spare = fallback.withColumn("_found", F.lit(1)).join(found, "_found", "left_anti").drop("_found")
    return primary.unionByName(spare)


def first_source_wins(sources: list[DataFrame], id_col: str, names: list[str] | None = None) -> DataFrame:
    """Union of hit lists in order of preference, one row per id; missing columns become null."""
    tagged = [d.withColumn("_src", F.lit(i)) for i, d in enumerate(sources)]
    if names:
        tagged = [d.withColumn("search_source", F.lit(n)) for d, n in zip(tagged, names)]
    out = tagged[0]
    for d in tagged[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    others = [c for c in out.columns if c != id_col]
    best = out.groupBy(id_col).agg(F.min_by(F.struct(*others), "_src").alias("_h"))
    return best.select(id_col, *[f"_h.{c}" for c in others if c != "_src"])


def top_up(primary: DataFrame, secondary: DataFrame, id_col: str, limit: int, score: str) -> DataFrame:
    """Add hits of ``secondary`` only where ``primary`` is short of ``limit``; ids stay unique.

    Both sides are already cut to at most a few times ``limit``.
    """
    short = primary.agg(F.count(F.lit(1)).alias("_have")).where(F.col("_have") < limit).select(
        F.lit(1).alias("_one"), (2 * (F.lit(limit) - F.col("_have"))).alias("_room"))
    order = Window.partitionBy("_one").orderBy(F.desc(score), id_col)
    ranked = (secondary.orderBy(F.desc(score), id_col).limit(2 * limit)
              .withColumn("_one", F.lit(1)).withColumn("_rank", F.row_number().over(order)))
    extra = ranked.join(short, "_one").where(F.col("_rank") <= F.col("_room")).drop("_one", "_rank", "_room")
    return first_source_wins([primary, extra], id_col, ["metadata", "semantic"])
