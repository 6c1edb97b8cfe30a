"""Queries of table construction, and of sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from vinctum.operators import tables as T
from vinctum.sources import files
from vinctum.sources.scratch import scratch

from .views import Registry

Q = Registry()
_IN = "SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'new' END AS a, 'nb' AS b FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey + 1000000, 'add', 'ab' FROM customer WHERE c_custkey % 7 = 0"


def _sides(c):
    target = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("a"), F.lit("old").alias("b"))
    incoming = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 6 != 0, "new").alias("a"), F.lit("nb").alias("b"))
    added = c.where("c_custkey % 7 = 0").select((F.col("c_custkey") + 1000000).alias("id"), F.lit("add").alias("a"), F.lit("ab").alias("b"))
    return target, incoming.unionByName(added)


_T = "t AS (SELECT c_custkey AS id, c_mktsegment AS a, 'old' AS b FROM customer)"
Q("upsert", "customer", sql=f"WITH {_T}, i AS ({_IN}) SELECT coalesce(t.id, i.id) AS id, CASE WHEN i.id IS NOT NULL THEN i.a ELSE t.a END AS a, coalesce(t.b, i.b) AS b FROM t FULL JOIN i ON t.id = i.id")(lambda c: T.upsert(*_sides(c), ["id"], ["a"]))
Q("upsert_coalesce", "customer", sql=f"WITH {_T}, i AS ({_IN}) SELECT coalesce(t.id, i.id) AS id, coalesce(i.a, t.a) AS a, coalesce(i.b, t.b) AS b FROM t FULL JOIN i ON t.id = i.id")(lambda c: T.upsert_coalesce(*_sides(c), ["id"], ["a", "b"]))
Q("insert_ignore", "customer", sql=f"WITH {_T}, i AS ({_IN}) SELECT * FROM t UNION ALL SELECT i.* FROM i WHERE id NOT IN (SELECT id FROM t)")(lambda c: T.insert_ignore(*_sides(c), ["id"], ["a", "b"]))


@Q("dedupe_notices", "v_registry", sql="""
WITH n AS (SELECT k, CASE WHEN k % 3 = 0 THEN 'https://p/' || (k % 50) END AS permalink, CASE WHEN k % 5 = 0 THEN '' ELSE municipio END AS name, CASE WHEN k % 11 <> 0 THEN fecha END AS date, entidad AS state FROM v_registry),
x AS (SELECT *, coalesce('p' || permalink, CASE WHEN name <> '' AND date IS NOT NULL THEN concat_ws('|', 'n', name, date, state) END) AS key FROM n)
SELECT k FROM x WHERE key IS NULL UNION ALL SELECT min(k) FROM x WHERE key IS NOT NULL GROUP BY key""")  # fmt: skip
def dedupe_notices(r):
    """K6."""
    n = r.select("k", F.when(F.col("k") % 3 == 0, F.concat(F.lit("https://p/"), (F.col("k") % 50).cast("string"))).alias("permalink"), F.when(F.col("k") % 5 == 0, "").otherwise(F.col("municipio")).alias("name"), F.when(F.col("k") % 11 != 0, F.col("fecha")).alias("date"), F.col("entidad").alias("state"))
    return T.dedupe_notices(n, ["k"]).select("k")


Q("pending", "orders", "events", sql="SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT event_id FROM events)")(lambda o, e: T.pending(o, e.select(F.col("event_id").alias("o_orderkey")), ["o_orderkey"]).select("o_orderkey"))


@Q("retry_split", "events", sql="SELECT event_id, 'again' AS part FROM events WHERE event_id % 9 = 0 AND event_id % 2 = 0 UNION ALL SELECT event_id, 'log' FROM events WHERE event_id % 2 = 0 AND event_id % 9 <> 0")
def retry_split(e):
    """K8."""
    log = e.where("event_id % 2 = 0").select("event_id", F.when(F.col("event_id") % 9 == 0, "failed").otherwise("ok").alias("status"))
    kept, again = T.retry_split(log, e, ["event_id"])
    return again.select("event_id", F.lit("again").alias("part")).unionByName(kept.select("event_id", F.lit("log").alias("part")))


@Q("replace_subset", "v_cuerpos", sql="SELECT codigo FROM v_cuerpos WHERE NOT starts_with(codigo, 'C1') UNION ALL SELECT 'C1-' || k FROM v_cuerpos WHERE k % 5 = 0")
def replace_subset(c):
    """U2."""
    return T.replace_subset(c.select("codigo"), "codigo", "C1", c.where("k % 5 = 0").select(F.concat(F.lit("C1-"), F.col("k").cast("string")).alias("codigo")))


Q("keep_first", "documents", sql="SELECT min(doc_id) AS doc_id FROM documents GROUP BY substr(text, 1, 100)")(lambda d: T.keep_first(d, F.substring("text", 1, 100), ["doc_id"]).select("doc_id"))
Q("flatten_kv", "events", sql="SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS kind FROM events")(
    lambda e: e.select("event_id", T.flatten_kv(F.array(F.struct(F.lit("k").alias("key"), F.lit("old").alias("value")), F.struct(F.lit("kind").alias("key"), F.col("event_type").alias("value")), F.struct(F.lit("k").alias("key"), F.get_json_object("props", "$.k").alias("value")), F.struct(F.lit("gone").alias("key"), F.lit(None).cast("string").alias("value")))).alias("m")).select("event_id", F.col("m")["k"].alias("k"), F.col("m")["kind"].alias("kind")))


@Q("sightings", "v_artifacts", sql="SELECT sha256(html) AS content_hash, count(DISTINCT (run_id, url)) AS n, count(DISTINCT run_id) AS n_runs, min(fetched) AS first, max(fetched) AS last FROM v_artifacts GROUP BY 1")
def sightings(a):
    """E5."""
    return T.sightings(a.withColumn("content_hash", F.sha2("html", 256)))


@Q("assemble_counts", "events", sql="SELECT count(*) FILTER (event_id % 9 <> 0) AS n_ok, count(*) FILTER (event_id % 9 = 0) AS n_failed FROM events")
def assemble_counts(e):
    """K1."""
    return T.assemble(e.select("event_id", F.when(F.col("event_id") % 9 == 0, "failed").otherwise("ok").alias("status")), "event_id")[1]


# --- sources and sinks: written to the shared folder and read back


@Q("registry_csv", "v_registry", sql="SELECT id, sexo, entidad, strftime(fecha, '%Y-%m-%d') AS fecha FROM v_registry")
def registry_csv(r):
    """Trimmed strings by column name."""
    path = scratch(r.sparkSession, "csv")
    r.select("id", F.concat(F.lit(" "), "sexo").alias("sexo"), "entidad", F.col("fecha").cast("string").alias("fecha")).write.option("header", True).csv(path)
    return files.read_registry(r.sparkSession, path, "id string, sexo string, entidad string, fecha string")


@Q("nested_json", "nation", sql="SELECT n_name AS name, n_regionkey::BIGINT AS region FROM nation")
def nested_json(n):
    """One document whose result.data.data holds the records."""
    path = scratch(n.sparkSession, "json")
    doc = n.agg(F.struct(F.struct(F.struct(F.collect_list(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"))).alias("data")).alias("data")).alias("result")).alias("x"))  # 25 nations
    doc.select("x.*").write.json(path)
    return files.read_nested(n.sparkSession, path, "result.data.data", "result struct<data:struct<data:array<struct<name:string,region:bigint>>>>")


@Q("jsonl_dropping_bad_lines", "events", sql="SELECT event_id, user_id FROM events WHERE event_id % 10 <> 0")
def jsonl_dropping_bad_lines(e):
    """S3: broken lines are skipped."""
    path = scratch(e.sparkSession, "jsonl")
    e.select(F.when(F.col("event_id") % 10 == 0, '{"event_id": ').otherwise(F.to_json(F.struct("event_id", "user_id"))).alias("value")).write.text(path)
    return files.read_jsonl(e.sparkSession, path, "event_id long, user_id long")


@Q("features_scan", "v_records", sql="SELECT id, coalesce(CASE WHEN length(id) % 3 = 0 THEN 'derecha' END, 'na') AS laterality, list_transform(string_split(raw_description, ' '), lambda x: lower(x))[2] AS second, len(string_split(raw_description, ' '))::INT AS n FROM v_records")
def features_scan(r):
    """Tokens are stored as JSON."""
    raw = r.select("id", F.when(F.length("id") % 3 == 0, "derecha").alias("laterality"), F.to_json(F.transform(F.split("raw_description", " "), F.lower)).alias("tokens"))
    return files.features(raw).select("id", "laterality", F.get("tokens", F.lit(1)).alias("second"), F.size("tokens").alias("n"))


Q("records_scan", "v_records", sql="SELECT id, estado FROM v_records WHERE record_type = 'missing'")(lambda r: files.records(r, "missing").select("id", "estado"))


@Q("geojson", "v_sites", sql="""
SELECT k, round(lng::DOUBLE, 6) AS lng, round(lat::DOUBLE, 6) AS lat, entidad, region::BIGINT AS region, (SELECT count(*) FROM v_sites WHERE lat IS NOT NULL AND lng IS NOT NULL) AS num_sitios,
  (SELECT sum(CASE WHEN regexp_full_match(trim(fosas), '[0-9]+') THEN trim(fosas)::BIGINT ELSE 0 END)::BIGINT FROM v_sites) AS total_fosas, (SELECT sum(CASE WHEN regexp_full_match(trim(cuerpos), '[0-9]+') THEN trim(cuerpos)::BIGINT ELSE 0 END)::BIGINT FROM v_sites) AS total_cuerpos FROM v_sites WHERE lat IS NOT NULL AND lng IS NOT NULL""")
def geojson(s):
    """K2: a FeatureCollection with totals, written and read back."""
    path = scratch(s.sparkSession, "geojson")
    files.write_feature_collection(s, path, "lng", "lat", ["k", "entidad", "region"], ["fosas", "cuerpos"], "k")
    lines = s.sparkSession.read.text(path)
    one = F.from_json(F.ltrim(F.col("value"), F.lit(",")), "struct<type:string,geometry:struct<coordinates:array<double>>,properties:struct<k:int,entidad:string,region:bigint>>")
    points = lines.where("value LIKE '%\"Feature\"%'").select(one.alias("f")).select(F.col("f.properties.k").alias("k"), F.round(F.col("f.geometry.coordinates")[0], 6).alias("lng"), F.round(F.col("f.geometry.coordinates")[1], 6).alias("lat"), "f.properties.entidad", "f.properties.region")
    head = lines.where("value LIKE '{\"type\":\"FeatureCollection\"%'").select(F.from_json(F.concat("value", F.lit("]}")), "struct<num_sitios:bigint,total_fosas:bigint,total_cuerpos:bigint>").alias("h")).select("h.*")
    return points.join(F.broadcast(head))


@Q("assemble_rows", "events", sql="SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'failed' ELSE 'ok' END AS status FROM events")
def assemble_rows(e):
    """K1: rows in order, written as JSON and read back."""
    path = scratch(e.sparkSession, "assembled")
    files.write_ordered_json(e.select("event_id", F.when(F.col("event_id") % 9 == 0, "failed").otherwise("ok").alias("status")), path, "event_id")
    return files.read_jsonl(e.sparkSession, path, "event_id long, status string")
