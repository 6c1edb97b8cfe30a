"""Structured Streaming: live matching, a replay-safe feed, notifications, refresh by content hash."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinctum.operators import kinds
from vinctum.operators import personas as B
from vinctum.operators.tables import pending
from vinctum.plans.config import MatchConfig
from vinctum.sources.scratch import materialize


def read_table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 8) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/{name}.parquet*")


def live_match(bodies: DataFrame, personas: DataFrame, out: str, checkpoint: str, cfg: MatchConfig = MatchConfig()):
    """Each new body is scored against the stored personas by its own fields and ranked; nothing but the ranking is written. Personas are tidied once, not in each batch."""
    tidy = materialize(B.tidy_personas(personas), "tidy-personas")

    def score(batch: DataFrame, epoch: int) -> None:
        kinds.reviewed(tidy, batch, cfg.top_k, cfg).select("b_id", "p_id", "score", "rank").write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return bodies.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Buckets of ids, each with one entry of keyed state.
STATE_BUCKETS = 256
_STATE = "hashes binary, days binary, top long"


def first_seen(stream: DataFrame, id_col: str, time_col: str | None = None, keep_days: int | None = None, buckets: int = STATE_BUCKETS) -> DataFrame:
    """Rows of the stream whose id has not come before, replayed or not, in any order of time; no row is dropped for being late.

    Without keep_days the state holds every id. With it an id is forgotten once its last row lies more than keep_days before the newest row of its bucket, so the state holds the ids of
    that span: 16 bytes each, in one entry a bucket of id hashes (two ids that share a 64-bit hash are taken for one); an id that comes again after it is forgotten passes once more. Rows without an id don't pass, rows
    without a time count as of the newest one.
    """
    stream = stream.where(F.col(id_col).isNotNull())
    if keep_days is None:
        return stream.dropDuplicates([id_col])
    bare = stream.withColumns({"_h": F.xxhash64(id_col), "_day": F.datediff(F.col(time_col).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")})
    keyed = bare.withColumn("_bucket", F.pmod("_h", F.lit(buckets)).cast("int"))

    def run(key, pdfs, state):
        h, day, top = (np.zeros(0, np.int64), np.zeros(0, np.int64), -(1 << 62)) if not state.exists else (np.frombuffer(state.get[0], "<i8"), np.frombuffer(state.get[1], "<i8"), state.get[2])
        for pdf in pdfs:
            mine = pdf["_h"].to_numpy(np.int64)
            days = pdf["_day"].astype("float64").to_numpy()
            top = max(top, int(np.nanmax(days))) if np.isfinite(days).any() else max(top, 0)
            days = np.where(np.isfinite(days), days, top).astype(np.int64)
            once, at = np.unique(mine, return_index=True)
            new = ~np.isin(once, h)
            yield pdf.iloc[np.sort(at[new])].drop(columns=["_h", "_day", "_bucket"])
            both, days = np.concatenate([h, mine]), np.concatenate([day, days])
            h, of = np.unique(both, return_inverse=True)
            day = np.full(len(h), np.iinfo(np.int64).min)
            np.maximum.at(day, of, days)
        on = day >= top - keep_days
        state.update((h[on].astype("<i8").tobytes(), day[on].astype("<i8").tobytes(), top))

    return keyed.groupBy("_bucket").applyInPandasWithState(run, stream.schema, _STATE, "append", "NoTimeout")


def case_feed(stream: DataFrame, id_col: str, keep: str, time_col: str | None = None, keep_days: int | None = None) -> DataFrame:
    """Rows of one case, each id once even when the source replays, however late; keep_days bounds the state (see first_seen)."""
    return first_seen(stream.where(keep), id_col, time_col, keep_days)


def notify(sources: dict[str, tuple[DataFrame, str]], links: DataFrame, out: str, checkpoint: str, keep_days: int | None = None, expand: bool = True):
    """One notification per linked user and new row of any source; sources: kind -> (stream of case_id, event_id and at, text).

    The streams keep their own pace and are read together; a row that a source replays is told apart by its kind and event_id and gives nothing more. A repeated
    epoch overwrites what it wrote. Without expand a new row is written once, for all users of its case: `notified` joins these to the links, `count_notified` counts
    without making them, as a case of many rows and many users has the product of both.
    """
    users = materialize(links, "links") if expand else None  # once, not in each batch
    each = [s.select("case_id", F.lit(kind).alias("kind"), F.lit(text).alias("text"), F.concat_ws("|", F.lit(kind), "event_id").alias("event"), F.col("at").cast("timestamp").alias("at")) for kind, (s, text) in sources.items()]

    def emit(batch: DataFrame, epoch: int) -> None:
        (batch if users is None else batch.join(users, "case_id")).drop("at").write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    new = first_seen(reduce(DataFrame.unionByName, each), "event", "at", keep_days)
    return new.writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def notified(rows: DataFrame, links: DataFrame) -> DataFrame:
    """The notifications of the rows that notify wrote without expand: one per linked user and row."""
    return rows.join(links, "case_id")


def count_notified(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Number n of `notified` by case and kind: a case's rows of a kind times its links."""
    many = rows.groupBy("case_id", "kind").agg(F.count(F.lit(1)).alias("_rows"))
    return many.join(links.groupBy("case_id").agg(F.count(F.lit(1)).alias("_links")), "case_id").select("case_id", "kind", (F.col("_rows") * F.col("_links")).alias("n"))


def refresh(stream: DataFrame, seen: DataFrame, out: str, checkpoint: str, time_col: str | None = None, keep_days: int | None = None):
    """New contents only: rows whose hash is neither in `seen` nor came before in the stream. What came before is kept as state, so no batch reads what earlier ones wrote."""

    def emit(batch: DataFrame, epoch: int) -> None:
        pending(batch, seen, ["content_hash"]).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    new = first_seen(stream, "content_hash", time_col, keep_days)
    return new.writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
