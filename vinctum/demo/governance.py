"""Queries of governance."""

from __future__ import annotations

from pyspark.sql import functions as F

from vinctum.operators import govern as G
from vinctum.operators import intervals, matching

from .views import Registry

Q = Registry()
_REV = "rev AS (SELECT event_id AS review_id, 'm' || (event_id % 300) AS match_id, CASE event_id % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rejected' ELSE 'note' END AS decision, ts AS seen FROM events)"


@Q("apply_reviews", "events", sql=f"WITH {_REV}, last AS (SELECT match_id, decision FROM rev WHERE decision IN ('confirmed', 'rejected') QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY seen DESC, review_id DESC) = 1), c AS (SELECT DISTINCT 'm' || (event_id % 310) AS id FROM events) SELECT id, coalesce(decision, 'in_review') AS status FROM c LEFT JOIN last ON match_id = id")
def apply_reviews(e):
    """Only reviews set a status."""
    reviews = e.select(F.col("event_id").alias("review_id"), F.concat(F.lit("m"), (F.col("event_id") % 300).cast("string")).alias("match_id"), F.when(F.col("event_id") % 4 == 0, "confirmed").when(F.col("event_id") % 4 == 1, "rejected").otherwise("note").alias("decision"), F.col("ts").alias("at"), F.col("user_id").alias("reviewer"))
    cands = e.select(F.concat(F.lit("m"), (F.col("event_id") % 310).cast("string")).alias("id")).distinct().withColumn("status", F.lit("in_review"))
    return G.apply_reviews(cands, reviews)[0]


@Q("review_audit", "events", sql=f"WITH {_REV}, last AS (SELECT match_id, decision FROM rev WHERE decision IN ('confirmed', 'rejected') QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY seen DESC, review_id DESC) = 1) SELECT 'match_' || decision AS action, match_id AS entity FROM last")
def review_audit(e):
    """One audit row per applied review."""
    reviews = e.select(F.col("event_id").alias("review_id"), F.concat(F.lit("m"), (F.col("event_id") % 300).cast("string")).alias("match_id"), F.when(F.col("event_id") % 4 == 0, "confirmed").when(F.col("event_id") % 4 == 1, "rejected").otherwise("note").alias("decision"), F.col("ts").alias("at"), F.col("user_id").alias("reviewer"))
    cands = e.select(F.concat(F.lit("m"), (F.col("event_id") % 310).cast("string")).alias("id")).distinct().withColumn("status", F.lit("in_review"))
    return G.apply_reviews(cands, reviews)[1].select("action", "entity")


Q("safe_view", "customer", sql="SELECT c_custkey, c_name, c_nationkey FROM customer")(lambda c: G.safe_view(c, ("c_acctbal", "c_mktsegment")))
Q("secure_read", "v_sites", sql="SELECT k, lat FROM v_sites")(lambda s: G.secure_read(s, "reviewer", "sites", "2024-01-01").select("k", "lat"))
Q("chat_view", "conversations", sql="SELECT conv_id, turn, 'Persona ' || a AS alias FROM (SELECT conv_id, turn, role FROM conversations) JOIN (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn), role) AS a FROM conversations GROUP BY conv_id, role) USING (conv_id, role)")(
    lambda c: G.safe_view(G.chat_view(c, "conv_id", "role", "turn"), ("text",)))
_V = ("v_consents", "v_artifacts", "v_jobs", "v_events", "v_lineage")
_HIT = "hit AS (SELECT id FROM v_artifacts WHERE consent_id = 'c6' AND purged IS NULL), reach AS (SELECT id FROM v_events WHERE artifact IN (SELECT id FROM hit) UNION SELECT event FROM v_lineage WHERE artifact IN (SELECT id FROM hit))"
Q("revoke_counts", *_V, sql=f"WITH {_HIT} SELECT (SELECT count(*) FROM hit) AS purged, (SELECT count(*) FROM v_jobs WHERE status <> 'failed' AND artifact IN (SELECT id FROM hit)) AS failed_jobs, (SELECT count(*) FROM v_events WHERE review <> 'hidden' AND id IN (SELECT id FROM reach)) AS hidden_events, 'asked' AS reason")(
    lambda c, a, j, e, li: G.revoke(c, a, j, e, li, "c6", "2024-02-01", "asked")["counts"])
Q("revoke_events", *_V, sql=f"WITH {_HIT} SELECT id, CASE WHEN id IN (SELECT id FROM reach) THEN 'hidden' ELSE review END AS review FROM v_events")(lambda c, a, j, e, li: G.revoke(c, a, j, e, li, "c6", "2024-02-01", "asked")["events"].select("id", "review"))
Q("events_of", "v_artifacts", "v_events", "v_lineage", sql="SELECT id FROM v_events WHERE artifact IN (SELECT id FROM v_artifacts WHERE run_id = 'run1') OR id IN (SELECT event FROM v_lineage WHERE artifact IN (SELECT id FROM v_artifacts WHERE run_id = 'run1'))")(
    lambda a, e, li: matching.events_of(a.where("run_id = 'run1'"), e, li))
Q("attach_lineage", "v_lineage", sql="SELECT event, artifact, CASE WHEN artifact % 4 = 0 THEN 'changed' ELSE role END AS role FROM v_lineage")(lambda li: G.attach_lineage(li, li.where("artifact % 4 = 0").withColumn("role", F.lit("changed"))))
Q("consent_in_force", "v_consents", sql="SELECT id FROM v_consents WHERE granted <= date '2024-01-20' AND (expires IS NULL OR expires > date '2024-01-20')")(lambda c: G.in_force(c, "2024-01-20", "granted", "expires").select("id"))


@Q("consents_at_fetch", "v_artifacts", "v_consents", sql="""
SELECT a.id, count(c.id)::INT AS n_in_force, arg_max(c.id, (c.granted, c.expires, c.id)) AS newest FROM v_artifacts a LEFT JOIN v_consents c ON c.source = a.run_id AND c.granted <= a.fetched AND (c.expires IS NULL OR c.expires > a.fetched) GROUP BY a.id""".replace("(c.granted, c.expires, c.id)", "(c.granted, c.id)"))  # fmt: skip
def consents_at_fetch(a, c):
    """The consents of its source in force when each artifact was fetched."""
    held = intervals.in_force_at(a.select("id", "fetched", F.col("run_id").alias("source")), "fetched", c.select("source", "granted", "id", "expires"), ["source"], "granted", "expires")
    return held.select("id", F.size("in_force").alias("n_in_force"), F.get("in_force", F.lit(0))["id"].alias("newest"))


_POLICY = "SELECT o_custkey % 50 AS source, o_orderkey AS policy, date '2024-01-01' + cast((o_orderkey * 7) % 365 as integer) AS valid_from, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE date '2024-01-01' + cast((o_orderkey * 7) % 365 + o_orderkey % 20 as integer) END AS valid_to FROM orders"


@Q("policy_at_event", "events", "orders", sql=f"""
WITH e AS (SELECT event_id, user_id % 50 AS source, ts::DATE AS day FROM events), v AS ({_POLICY}), d AS (SELECT DISTINCT source, day FROM e),
f AS (SELECT source, day, arg_max(policy, (valid_from, policy)) AS policy FROM d JOIN v USING (source) WHERE valid_from <= day AND (valid_to IS NULL OR valid_to > day) GROUP BY ALL)
SELECT event_id, policy FROM e LEFT JOIN f USING (source, day)""")
def policy_at_event(e, o):
    """Each event gets the newest policy version of its source that was in force on its day."""
    x = (F.col("o_orderkey") * 7 % 365).cast("int")
    versions = o.select((F.col("o_custkey") % 50).alias("source"), F.date_add(F.lit("2024-01-01").cast("date"), x).alias("valid_from"), F.col("o_orderkey").alias("policy"), F.when(F.col("o_orderkey") % 11 != 0, F.date_add(F.lit("2024-01-01").cast("date"), x + (F.col("o_orderkey") % 20).cast("int"))).alias("valid_to"))
    days = e.select("event_id", (F.col("user_id") % 50).alias("source"), F.col("ts").cast("date").alias("day"))
    return intervals.policy_at(days, "day", versions, ["source"], "valid_from", "valid_to", step_days=5).select("event_id", "policy")


Q("expired_artifacts", "v_artifacts", sql="SELECT id, fetched + retention_days AS expires FROM v_artifacts WHERE fetched + retention_days <= date '2024-03-01' AND purged IS NULL")(lambda a: G.expired(a, "2024-03-01").select("id", "expires"))
Q("publishable", "v_events", sql="SELECT estado, municipio, kind, count(*) AS n FROM v_events WHERE confidence >= 0.5 AND review = 'approved' AND privacy = 'public' GROUP BY ALL HAVING count(*) >= 1")(lambda e: G.publishable(e, k=1, confident=0.5))


_SOURCES = "SELECT DISTINCT 'run' || (page_id % 5) AS source, page_id % 5 <> 2 AS allowed, date '2024-01-01' + cast(page_id % 5 * 10 as integer) AS valid_from, CASE WHEN page_id % 5 = 0 THEN date '2024-02-01' END AS valid_to FROM pages"


@Q("publishable_by_source", "v_events", "pages", sql=f"""WITH s AS ({_SOURCES})
SELECT estado, municipio, kind, count(*) AS n FROM v_events WHERE confidence >= 0.3 AND review = 'approved' AND privacy = 'public' AND 'run' || (artifact % 5) IN (SELECT source FROM s WHERE allowed AND valid_from <= date '2024-02-10' AND (valid_to IS NULL OR valid_to > date '2024-02-10')) GROUP BY ALL HAVING count(*) >= 1""")
def publishable_by_source(e, p):
    """Only events of sources that are allowed at the time."""
    i = F.col("page_id") % 5
    sources = p.select(F.concat(F.lit("run"), i.cast("string")).alias("source"), (i != 2).alias("allowed"), F.date_add(F.lit("2024-01-01").cast("date"), (i * 10).cast("int")).alias("valid_from"), F.when(i == 0, F.lit("2024-02-01").cast("date")).alias("valid_to")).distinct()
    return G.publishable(e.withColumn("source", F.concat(F.lit("run"), (F.col("artifact") % 5).cast("string"))), k=1, confident=0.3, sources=sources, at="2024-02-10")


_ROLES = {"reviewer": G.RolePolicy(("k", "entidad", "lat", "lng")), "liaison": G.RolePolicy(("k", "entidad", "lat", "lng"), "region < 3", (("lat", "round(lat, 0)"), ("lng", "round(lng, 0)")))}
Q("role_view", "v_sites", sql="SELECT k, entidad, round(lat, 0)::DOUBLE AS lat, round(lng, 0)::DOUBLE AS lng FROM v_sites WHERE region < 3")(
    lambda s: G.role_view(s.withColumns({"lat": F.col("lat").cast("double"), "lng": F.col("lng").cast("double")}), "liaison", _ROLES, "sites", "2024-01-01")[0])
