"""Directory and record searches. Pages are the feature's own limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinctum.operators.dealt import dealt_join
from vinctum.operators.ranking import global_countdown
from vinctum.sources.scratch import materialize


def _has(col, part: str):
    return F.contains(F.lower(col), F.lit(part.lower()))


def search_people(df: DataFrame, names: list[str], id_col: str, state: str | None = None, sex: str | None = None, q: str | None = None, limit: int = 24, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(page, total): state and name contain, sex equals, ordered by id."""
    out = df
    if state:
        out = out.where(_has("estado", state))
    if sex:
        out = out.where(F.upper("sexo") == sex.upper())
    if q:
        hit = F.lit(False)
        for n in names:
            hit = hit | F.coalesce(_has(n, q), F.lit(False))
        out = out.where(hit)
    limit, offset = min(max(limit, 1), 100), max(offset, 0)
    return out.orderBy(id_col).offset(offset).limit(limit), out.agg(F.count(F.lit(1)).alias("total"))


def search_records(df: DataFrame, q: str | None = None, estado: str | None = None, record_type: str | None = None, limit: int = 20) -> DataFrame:
    """The first records by id whose description or municipality has q."""
    out = df
    if record_type:
        out = out.where(F.col("record_type") == record_type)
    if estado:
        out = out.where(F.col("estado") == estado)
    if q:
        hit = _has("raw_description", q)
        out = out.where(hit | F.coalesce(_has("municipio", q), F.lit(False)) if "municipio" in out.columns else hit)
    return out.orderBy("id").limit(limit)


def search_pages(df: DataFrame, title: str, body: str, q: str, limit: int = 10) -> DataFrame:
    """The first pages by id whose title or body has q, with rank and a description of 160 characters."""
    hits = df.where(_has(title, q) | _has(body, q)).orderBy("page_id").limit(limit)
    from pyspark.sql import Window

    return hits.withColumn("rank", F.row_number().over(Window.orderBy("page_id"))).withColumn("description", F.substring(body, 1, 160))  # limit rows


def having_mark(df: DataFrame, marks: str, value: str) -> DataFrame:
    return df.where(F.array_contains(marks, value))


def fetchable(df: DataFrame, *ids: str) -> DataFrame:
    keep = F.lit(True)
    for i in ids:
        keep = keep & F.col(i).isNotNull() & (F.upper(F.trim(F.col(i).cast("string"))) != "CONFIDENCIAL")
    return df.where(keep)


def trigrams(x):
    t = F.concat(F.lit("  "), F.lower(x), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substr(t, i, F.lit(3))))


def similar_names(df: DataFrame, name: str, q: str, min_sim: float) -> DataFrame:
    """Names whose trigram set has a Jaccard similarity of min_sim or more with q's."""
    a, b = trigrams(F.col(name)), trigrams(F.lit(q))
    sim = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return df.withColumn("similarity", sim).where(F.col("similarity") >= min_sim)


def similar_pairs(df: DataFrame, id_col: str, name: str, queries: str, min_sim: float) -> DataFrame:
    """(query_id, id, similarity) of the rows that `queries` selects against all rows, by trigram sets with a Jaccard similarity of min_sim or more.

    Names with the same set of trigrams are one class: each class is posted under its rarest trigrams only (sets that are similar share one of them), with its whole set as numbers, the rarest
    first. So classes are compared where they meet, and a pair counts at the first trigram that both have: none is moved or made distinct. The rows of both classes then meet by their class.
    Classes are dealt over tasks in both joins, so that no task and no broadcast holds the pairs.
    """
    rows = materialize(df.where(F.col(name).isNotNull()).select(F.col(id_col).alias("id"), trigrams(F.col(name)).alias("g"), F.coalesce(F.expr(queries), F.lit(False)).alias("asks")).withColumn("c", F.sha2(F.array_join(F.array_sort("g"), "\n"), 256)), "names")
    classes = materialize(rows.groupBy("c").agg(F.any_value("g").alias("g"), F.bool_or("asks").alias("asks")).withColumn("k", F.monotonically_increasing_id()), "name-classes")
    one = classes.select("k", "asks", F.explode("g").alias("t"))
    numbers = global_countdown(one.groupBy("t").agg(F.count(F.lit(1)).alias("df")), "df", "t").select("t", F.col("queue_priority").alias("x"))
    sets = one.join(numbers, "t").groupBy("k", "asks").agg(F.array_sort(F.collect_list("x")).alias("b")).withColumn("n", F.size("b"))  # a name's trigrams
    posted = materialize(sets.select("*", F.explode(F.expr(f"slice(b, 1, cast(n - ceil({min_sim}D * n - 1e-9D) + 1 as int))")).alias("x")), "posted")
    q = posted.where("asks").select(F.col("k").alias("qk"), F.col("n").alias("m"), F.col("b").alias("a"), "x")
    met = dealt_join(posted.drop("asks"), q, ["x"], "k").where(f"least(n, m) >= {min_sim}D * greatest(n, m) - 1e-9D").withColumn("both", F.array_intersect("a", "b"))
    similar = met.where(F.get("both", F.lit(0)) == F.col("x")).select("qk", "k", (F.size("both") / (F.col("m") + F.col("n") - F.size("both"))).alias("similarity"))
    similar = materialize(similar.where(F.col("similarity") >= min_sim), "similar-classes")
    mine = materialize(rows.join(classes.select("c", "k"), "c").select("id", "asks", "k"), "names-by-class")
    asked = mine.where("asks").select(F.col("id").alias("query_id"), F.col("k").alias("qk")).join(similar, "qk").drop("qk")
    return dealt_join(asked, mine.select("id", "k"), ["k"], "query_id").select("query_id", "id", "similarity")
