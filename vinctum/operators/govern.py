"""Role gates, safe views, reviews, consent, lineage, retention and publication. Time is always an argument."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .aggregate import k_anonymous
from .ranking import latest_per
from .tables import upsert

SECURE_ROLES = ("reviewer", "liaison", "admin")


class AccessDenied(PermissionError):
    """The role may not read secure rows; `audit` holds the row to append."""

    def __init__(self, audit: DataFrame):
        super().__init__("role may not read secure rows")
        self.audit = audit


def audit_rows(spark, action: str, entity: str, at: str, **detail) -> DataFrame:
    row = spark.range(1).select(F.lit(action).alias("action"), F.lit(entity).alias("entity"), F.lit(at).cast("timestamp").alias("at"))
    values = [F.lit(str(v)).alias(k) for k, v in sorted(detail.items())]
    return row.withColumn("detail", F.to_json(F.struct(*values)) if values else F.lit("{}"))


def secure_read(df: DataFrame, role: str, entity: str, at: str) -> DataFrame:
    if role not in SECURE_ROLES:
        raise AccessDenied(audit_rows(df.sparkSession, "secure_read_denied", entity, at, role=role))
    return df


@dataclass(frozen=True)
class RolePolicy:
    """What a role may read: columns, the rows of a condition, and columns that it gets degraded by an expression."""

    columns: tuple[str, ...]
    rows: str = "true"
    degraded: tuple[tuple[str, str], ...] = ()


def role_view(df: DataFrame, role: str, policies: dict[str, RolePolicy], entity: str, at: str) -> tuple[DataFrame, DataFrame]:
    """(the rows and columns that the role may read, the audit row of the access). A role without a policy is refused with an audit row of its own.

    Projection and condition are pushed into the scan, so columns that are not allowed are not read.
    """
    if role not in policies:
        raise AccessDenied(audit_rows(df.sparkSession, "access_denied", entity, at, role=role))
    policy = policies[role]
    shown = dict(policy.degraded)
    view = df.where(F.expr(policy.rows)).select(*[F.expr(shown[c]).alias(c) if c in shown else F.col(c) for c in policy.columns])
    return view, audit_rows(df.sparkSession, "accessed", entity, at, role=role, columns=",".join(policy.columns))


def safe_view(df: DataFrame, hidden: tuple[str, ...] = ("phone", "permalink")) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in hidden])


def chat_view(messages: DataFrame, case: str, author: str, order: str) -> DataFrame:
    """Messages with an alias per case, by first message, instead of the author."""
    first = messages.groupBy(case, author).agg(F.min(order).alias("_first"))
    w = Window.partitionBy(case).orderBy("_first", author)
    alias = first.withColumn("alias", F.concat(F.lit("Persona "), F.row_number().over(w).cast("string"))).drop("_first")
    return messages.join(alias, [case, author]).drop(author)


def apply_reviews(candidates: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates with the status of their latest review, an audit row per applied review). Nothing else confirms a match."""
    last = latest_per(reviews.where("decision IN ('confirmed', 'rejected')"), "match_id", "at", "review_id").select("match_id", "decision", "reviewer", "at")
    j = candidates.join(last, candidates["id"] == last["match_id"], "left")
    audit = j.where("decision IS NOT NULL").select(F.concat(F.lit("match_"), "decision").alias("action"), F.col("id").alias("entity"), "at", F.to_json(F.struct("reviewer")).alias("detail"))
    return j.withColumn("status", F.coalesce("decision", "status")).select(*candidates.columns), audit


def revoke(consents: DataFrame, artifacts: DataFrame, jobs: DataFrame, events: DataFrame, lineage: DataFrame, consent_id: str, at: str, reason: str) -> dict[str, DataFrame]:
    """New versions of the tables after a consent is revoked, and counts. A second call changes nothing.

    The four tables are written one by one by the caller; the swap is not atomic across them.
    """
    when = F.lit(at).cast("date")
    mine = F.col("id") == consent_id
    c = consents.withColumn("revoked", F.when(mine & F.col("revoked").isNull(), when).otherwise(F.col("revoked")))
    hit = artifacts.where((F.col("consent_id") == consent_id) & F.col("purged").isNull()).select(F.col("id").alias("artifact"))
    a = artifacts.join(hit.withColumn("_hit", F.lit(True)), artifacts["id"] == hit["artifact"], "left").withColumn("purged", F.when(F.col("_hit"), when).otherwise(F.col("purged"))).select(*artifacts.columns)
    failing = jobs.where("status <> 'failed'").join(hit, "artifact", "left_semi").select(F.col("id").alias("_job"))
    j = jobs.join(failing.withColumn("_hit", F.lit(True)), jobs["id"] == failing["_job"], "left").withColumn("status", F.when(F.col("_hit"), "failed").otherwise(F.col("status"))).select(*jobs.columns)
    reached = events.join(hit, "artifact", "left_semi").select(F.col("id").alias("_event")).unionByName(lineage.join(hit, "artifact", "left_semi").select(F.col("event").alias("_event"))).distinct()
    hiding = events.where("review <> 'hidden'").join(reached, F.col("id") == F.col("_event"), "left_semi").select(F.col("id").alias("_event"))
    e = events.join(hiding.withColumn("_hit", F.lit(True)), F.col("id") == F.col("_event"), "left").withColumn("review", F.when(F.col("_hit"), "hidden").otherwise(F.col("review"))).select(*events.columns)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    counts = n(hit, "purged").join(F.broadcast(n(failing, "failed_jobs"))).join(F.broadcast(n(hiding, "hidden_events"))).withColumn("reason", F.lit(reason))
    return {"consents": c, "artifacts": a, "jobs": j, "events": e, "counts": counts}


def attach_lineage(lineage: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(lineage, incoming, ["event", "artifact"], ["role"])


def in_force(df: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """Rows whose [start, end) holds the time; an open end never ends."""
    t = F.lit(at).cast("date")
    return df.where((F.col(start) <= t) & (F.col(end).isNull() | (F.col(end) > t)))


def with_expiry(artifacts: DataFrame) -> DataFrame:
    return artifacts.withColumn("expires", F.date_add("fetched", F.col("retention_days").cast("int")))


def expired(artifacts: DataFrame, at: str) -> DataFrame:
    return with_expiry(artifacts).where((F.col("expires") <= F.lit(at).cast("date")) & F.col("purged").isNull())


def publishable(events: DataFrame, k: int = 5, confident: float = 0.85, sources: DataFrame | None = None, at: str | None = None) -> DataFrame:
    """Cells (state, municipality, kind) of approved, public, confident events of allowed sources, with k of them or more.

    sources: (source, allowed, valid_from, valid_to); an event's `source` must have a version that is allowed and in force at the time `at`. Without the table all sources are allowed.
    """
    if sources is not None:
        fine = in_force(sources.where("allowed"), at, "valid_from", "valid_to").select("source").distinct()
        events = events.join(fine, "source", "left_semi")
    ok = events.withColumn("review", F.when(F.col("confidence") < confident, "pending").otherwise(F.col("review"))).where("review = 'approved' AND privacy = 'public'")
    return k_anonymous(ok.groupBy("estado", "municipio", "kind").agg(F.count(F.lit(1)).alias("n")), "n", k)
