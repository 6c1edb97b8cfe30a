"""Structured vectors, cosine, exact retrieval in blocks, greedy clusters, embedding backfill."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vinctum.sources.scratch import materialize

from .tables import upsert

AGE_MEAN, AGE_STD = 31.9, 14.5
STATE_DIMS, MUNI_DIMS = 32, 64
DIMS = 7 + STATE_DIMS + MUNI_DIMS


def fnv(text: Column, seed: int) -> Column:
    """32-bit FNV-1a of the code points, the offset basis mixed with a seed; bigint throughout, so nothing overflows."""
    codes = F.filter(F.transform(F.split(text, ""), lambda ch: F.ascii(ch).cast("long")), lambda x: x > 0)
    return F.aggregate(codes, F.lit(2166136261 ^ seed).cast("long"), lambda h, x: (h.bitwiseXOR(x) * 16777619).bitwiseAND(F.lit(4294967295)))


def hashed(text: Column, seed: int, dims: int) -> tuple[Column, Column]:
    """(bucket from 0, sign)."""
    h = fnv(text, seed)
    return (h % dims).cast("int"), F.when(F.shiftright(h, 1).bitwiseAND(F.lit(1).cast("long")) == 1, 1.0).otherwise(-1.0)


def vectorize(df: DataFrame, age: str = "age", sex: str = "sexo", year: str = "year", month: str = "month", state: str = "entidad", code: str = "cve_ent", muni: str = "municipio") -> DataFrame:
    """Adds `vec`: age, sex one-hot, year, month on a circle, and signed hashes of state and municipality."""
    none = F.lit(0.0)
    head = F.array(
        F.coalesce((F.col(age) - AGE_MEAN) / AGE_STD, none), F.when(F.col(sex) == "HOMBRE", 1.0).otherwise(0.0), F.when(F.col(sex) == "MUJER", 1.0).otherwise(0.0), F.when(F.col(sex).isin("HOMBRE", "MUJER"), 0.0).otherwise(1.0),
        F.coalesce((F.col(year) - 1964) / F.lit(62.0), none), F.coalesce(F.sin(2 * np.pi * F.col(month) / 12), none), F.coalesce(F.cos(2 * np.pi * F.col(month) / 12), none),
    )
    eb, es = hashed(F.concat(F.lit("EST|"), F.coalesce(state, F.lit(""))), 11, STATE_DIMS)
    mb, ms = hashed(F.concat(F.lit("MUN|"), F.coalesce(code, F.lit("")), F.lit("|"), F.coalesce(muni, F.lit(""))), 23, MUNI_DIMS)
    df = df.withColumns({"_eb": eb, "_es": es, "_mb": mb, "_ms": ms})
    tail = F.expr(f"concat(transform(sequence(0, {STATE_DIMS - 1}), i -> IF(i = _eb, _es, 0D)), transform(sequence(0, {MUNI_DIMS - 1}), i -> IF(i = _mb, _ms, 0D)))")
    return df.withColumn("vec", F.concat(head, tail)).drop("_eb", "_es", "_mb", "_ms")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(a) -> Column:
    n = F.sqrt(dot(a, a))
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def cosine(a, b) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def unit_rows(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay."""
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def unit_column(vecs: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column of lists, as unit rows; no Python object is made of a component."""
    vecs = vecs.combine_chunks() if isinstance(vecs, pa.ChunkedArray) else vecs
    if not len(vecs):
        return np.zeros((0, 0))
    dims = pa.compute.unique(pa.compute.list_value_length(vecs)).to_pylist()
    if len(dims) > 1:
        raise ValueError(f"vectors of different lengths: {dims[:5]}")
    return unit_rows(vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vecs), dims[0]))


def best_columns(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k greatest values of each row, equal ones (to 12 decimals) by column."""
    key = -np.round(sims, 12)
    if sims.shape[1] <= k:
        row, col = np.divmod(np.arange(sims.size), max(1, sims.shape[1]))
    else:
        row, col = np.nonzero(key <= np.partition(key, k - 1, axis=1)[:, k - 1 : k])
    order = np.lexsort((col, key[row, col], row))
    row, col = row[order], col[order]
    on = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[on], col[on]


def least_ranks(pairs: DataFrame, k: int, threshold: float | None) -> DataFrame:
    """pairs (query_id, id, similarity) with rank, the first k of each query; then those of at least the threshold."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 12)), "id")
    top = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top if threshold is None else top.where(F.col("similarity") >= threshold)


#: Bytes of query vectors and of their best rows that a task holds at a time; rows and queries that it multiplies at once.
QUERY_BYTES, CORPUS_ROWS, QUERY_ROWS = 32 << 20, 4096, 512


def _keep_best(held, row, ids, sims, k: int):
    """(row, ids, sims) of both, by row, the k best of each row, equal ones by id."""
    if held:
        row, ids, sims = np.concatenate([held[0], row]), pa.concat_arrays([held[1], ids]), np.concatenate([held[2], sims])
    order = np.lexsort((np.argsort(np.array(pa.compute.array_sort_indices(ids))), -np.round(sims, 12), row))
    order = order[np.arange(len(row)) - np.searchsorted(row[order], row[order]) < k]
    return row[order], ids.take(pa.array(order)), sims[order]


def nearest_rows(batches: Iterator[pa.RecordBatch], q_ids: pa.Array, q: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """(query_id, id, similarity) of the k rows of the batches (id, vec) nearest to each query, multiplied in pieces of QUERY_ROWS times CORPUS_ROWS."""
    held: list = [None] * -(-len(q) // QUERY_ROWS)
    worst = np.full(len(q), -np.inf)  # the least similarity that a query keeps, once it has k rows
    for b in (batch.slice(at, CORPUS_ROWS) for batch in batches for at in range(0, batch.num_rows, CORPUS_ROWS)):
        by_id = np.array(pa.compute.array_sort_indices(b.column("id")))
        ids, v = b.column("id").take(pa.array(by_id)), unit_column(b.column("vec"))[by_id].T
        for i in range(len(held)):
            mine = slice(i * QUERY_ROWS, (i + 1) * QUERY_ROWS)
            sims = q[mine] @ v
            row, col = best_columns(sims, k) if np.isinf(worst[mine]).any() else np.nonzero(np.round(sims, 12) >= worst[mine, None])
            if len(row):
                held[i] = got = _keep_best(held[i], row, ids.take(pa.array(col)), sims[row, col], k)
                first, n = np.unique(got[0], return_index=True, return_counts=True)[1:]
                full = first[n == k]
                worst[mine.start + got[0][full]] = np.round(got[2][full + k - 1], 12)
    for i, got in enumerate(held):
        if got:
            yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(got[0] + i * QUERY_ROWS)), got[1], pa.array(got[2])], names=["query_id", "id", "similarity"])


def retrieve(queries: DataFrame, corpus: DataFrame, k: int, threshold: float | None = None, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, id, similarity, rank): the k nearest corpus rows by cosine, exactly; then those of at least the threshold.

    queries and corpus have (id, vec), with ids of any type; rows without either are left out. Queries of equal vectors are looked up once. The corpus is read once for each group of
    queries of query_bytes (vectors and results), which is sent to all tasks; a task multiplies QUERY_ROWS queries with CORPUS_ROWS rows at a time, whatever the sizes of group and corpus, and
    keeps the k best of each query, which is all that it passes on. For many queries use an index (vector_index.search).
    """
    spark = queries.sparkSession
    q_kind, c_kind = (d.schema["id"].dataType.simpleString() for d in (queries, corpus))
    known = queries.where("id IS NOT NULL AND vec IS NOT NULL").select("id", "vec")
    asked = materialize(known.groupBy("vec").agg(F.min("id").alias("id")), "query-vectors")
    members = known.select(F.col("id").alias("query_id"), "vec").join(asked.withColumnRenamed("id", "_first"), "vec").select("query_id", "_first")
    corpus = corpus.where("id IS NOT NULL AND vec IS NOT NULL").select("id", "vec")
    size = asked.agg(F.coalesce(F.sum(8 * F.size("vec") + 64 + 32 * k), F.lit(0)).alias("b")).first()["b"]
    groups = max(1, -(-size // query_bytes))
    schema = f"query_id {q_kind}, id {c_kind}, similarity double"

    def nearest(some: DataFrame) -> DataFrame:
        rows = some.select("id", "vec").toArrow()
        sent = spark.sparkContext.broadcast((rows.column("id").combine_chunks(), unit_column(rows.column("vec"))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from nearest_rows(batches, *sent.value, k)

        return corpus.mapInArrow(run, schema)

    if groups == 1:
        found = least_ranks(nearest(asked), k, threshold)
    else:
        found = reduce(DataFrame.unionByName, [materialize(least_ranks(nearest(asked.where(F.pmod(F.xxhash64("id"), F.lit(groups)) == g)), k, threshold), "nearest") for g in range(groups)])
    return found.withColumnRenamed("query_id", "_first").join(members, "_first").select("query_id", "id", "similarity", "rank")


#: Distinct vectors of a block that one task compares; of larger blocks so many are judged as seeds at a time, and so many rows meet them in a task.
LOCAL_ROWS, SEED_ROWS, PART_ROWS = 4096, 2048, 20_000


def _fold(ids: np.ndarray, n: np.ndarray, v: np.ndarray, threshold: float, min_size: int):
    """(seed, member, size, similarity to the least alike) by place; rows in order of id."""
    seen = np.zeros(len(ids), bool)
    for i in range(len(ids)):
        if seen[i]:
            continue
        open_ = np.flatnonzero(~seen)
        sims = np.round(v[open_] @ v[i], 12)
        on = (sims >= threshold) | (open_ == i)
        members, size = open_[on], int(n[open_[on]].sum())
        if size >= min_size:
            seen[members] = True
            least = float(min(1.0, sims[on].min()))
            for m in members:
                yield i, m, size, least


def _hot_clusters(classes: DataFrame, threshold: float, min_size: int, seed_rows: int, part_rows: int) -> DataFrame:
    """(block, seed, first, size, similarity) of blocks too large for a task.

    By rounds: of each block the first rows that are still open are judged against each other, which tells the next seeds; all open rows of the block,
    dealt over tasks, go to the first seed that they are like. A seed with too few rows takes none and is passed over; if it had others, what comes after
    it is judged anew. Rows meet seeds only, never each other.
    """
    id_type = classes.schema["first"].dataType.simpleString()
    sizes = classes.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts"))
    open_ = classes.join(sizes, "block").withColumn("part", F.pmod(F.xxhash64("first"), F.col("parts")).cast("int")).withColumn("passed", F.lit(False)).select("block", "part", "parts", "first", "n", "vec", "passed")
    done = None
    while True:
        open_ = materialize(open_, "open-vectors")
        w = Window.partitionBy("block").orderBy("first")
        batch = open_.where("NOT passed").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= seed_rows)  # limited before the shuffle

        def seeds(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("first")
            v = unit_rows(np.array(pdf["vec"].tolist(), np.float64))
            free, found = np.ones(len(v), bool), []
            for i in range(len(v)):
                if free[i]:
                    found.append(i)
                    free &= np.round(v @ v[i], 12) < threshold
            return pd.DataFrame([(pdf["block"].iloc[0], pdf["first"].iloc[found].tolist(), v[found].tobytes(), pdf["parts"].iloc[0])], columns=["block", "seeds", "vecs", "parts"])

        found = materialize(batch.select("block", "parts", "first", "vec").groupBy("block").applyInPandas(seeds, f"block string, seeds array<{id_type}>, vecs binary, parts int"), "seeds")
        if found.isEmpty():
            return done if done is not None else classes.sparkSession.createDataFrame([], f"block string, seed {id_type}, first {id_type}, size long, similarity double")
        each = found.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("block", "part", "seeds", "vecs")

        def take(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame([], columns=["block", "first", "n", "seed", "sim"])
            ids = list(right["seeds"].iloc[0])
            s = np.frombuffer(right["vecs"].iloc[0]).reshape(len(ids), -1)
            sims = np.round(unit_rows(np.array(left["vec"].tolist(), np.float64)) @ s.T, 12)
            own = left["first"].to_numpy()[:, None] == np.array(ids)[None, :]
            like = (sims >= threshold) | own
            at = like.argmax(1)
            on = like.any(1)
            rows = zip(left["block"].tolist(), left["first"].tolist(), left["n"].tolist(), at, np.minimum(1.0, sims[np.arange(len(at)), at]), on)
            return pd.DataFrame([(b, f, n, ids[i], x) for b, f, n, i, x, y in rows if y], columns=["block", "first", "n", "seed", "sim"])

        taken = open_.select("block", "part", "first", "n", "vec").groupBy("block", "part").cogroup(each.groupBy("block", "part")).applyInPandas(take, f"block string, first {id_type}, n long, seed {id_type}, sim double")
        taken = materialize(taken, "taken")
        groups = taken.groupBy("block", "seed").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("members"), F.min("sim").alias("similarity"))
        cut = groups.where((F.col("size") < min_size) & (F.col("members") > 1)).groupBy("block").agg(F.min("seed").alias("cut"))
        judged = groups.join(cut, "block", "left").where("cut IS NULL OR seed <= cut")
        judged = materialize(judged.select("block", "seed", "size", "similarity", (F.col("size") >= min_size).alias("ok")), "judged")
        got = taken.join(judged.where("ok"), ["block", "seed"]).select("block", "seed", "first", "size", "similarity")
        got = materialize(got, "duplicates")
        done = got if done is None else done.unionByName(got)
        passed = judged.where("NOT ok").select("block", F.col("seed").alias("first"), F.lit(True).alias("now"))
        open_ = open_.join(got.select("block", "first"), ["block", "first"], "left_anti").join(passed, ["block", "first"], "left")
        open_ = open_.select("block", "part", "parts", "first", "n", "vec", (F.col("passed") | F.coalesce("now", F.lit(False))).alias("passed"))


def greedy_duplicates(df: DataFrame, block: str, threshold: float = 0.97, min_size: int = 2, local_rows: int = LOCAL_ROWS, seed_rows: int = SEED_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """(block, seed, id, size, similarity) for each member. Rows (id, vec) of a block are seeds in order of id; a seed takes all unseen rows that are similar.

    Equal vectors are taken together, so they are one row of the least id with a count: the first of them is their seed, or none is. A zero vector is like nothing, not even
    itself, and in no cluster. Blocks of up to local_rows distinct vectors are one task's work each; larger ones are resolved by rounds over many tasks.
    """
    kind = dict(df.dtypes)["id"]
    keyed = df.select(F.col(block).cast("string").alias("block"), "id", "vec").withColumn("_key", F.hash("vec").cast("long"))
    classes = keyed.groupBy("block", "_key", "vec").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    # a written flag, as a condition on vec would be carried through the join below into the making of the vectors
    classes = materialize(classes.withColumn("_some", F.exists("vec", lambda x: x != 0)), "vector-classes").where("_some")
    hot = materialize(classes.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > local_rows).select("block"), "hot-blocks")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first")
        ids = pdf["first"].to_numpy()
        rows = [(pdf["block"].iloc[0], ids[i], ids[m], size, least) for i, m, size, least in _fold(ids, pdf["n"].to_numpy(), unit_rows(np.array(pdf["vec"].tolist(), np.float64)), threshold, min_size)]
        return pd.DataFrame(rows, columns=["block", "seed", "first", "size", "similarity"])

    schema = f"block string, seed {kind}, first {kind}, size long, similarity double"
    plain = classes.select("block", "first", "n", "vec")
    found = plain.join(hot, "block", "left_anti").groupBy("block").applyInPandas(run, schema)
    if not hot.isEmpty():
        found = found.unionByName(_hot_clusters(plain.join(hot, "block", "left_semi"), threshold, min_size, seed_rows, part_rows))
    placed = found.join(classes.select("first", "_key", "vec", F.col("block").alias("_block")), ["first"]).where("block = _block")
    members = keyed.join(placed.select("block", "_key", "vec", "seed", "size", "similarity"), ["block", "_key", "vec"])
    return members.select("block", "seed", "id", "size", "similarity")


def window_clusters(df: DataFrame, keys: list[str], order: str, max_span: int, min_size: int = 3) -> DataFrame:
    """(keys, first, last, size) of runs of rows whose `order` (a whole number) lies within max_span of the run's first.

    From each row in order the run is taken; if it is long enough its rows are used up, else only the first is. Rows of one number are counted together: they
    all begin a run or none does. A range window gives each number its run's length, and a fold over the long ones
    takes them from left to right.
    """
    n = df.where(F.col(order).isNotNull()).groupBy(*keys, F.col(order).cast("long").alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_x").rangeBetween(0, max_span)
    runs = n.select(*keys, "_x", F.max("_x").over(w).alias("_last"), F.sum("_n").over(w).alias("_size")).where(F.col("_size") >= min_size)
    g = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("_x").alias("first"), F.col("_last").alias("last"), F.col("_size").cast("int").alias("size")))).alias("runs"))  # distinct numbers of a key
    # a run is taken if it begins beyond the one taken last: mark it, then keep the marked ones
    taken = f"""aggregate(runs, named_struct('next', cast(null as bigint), 'out', cast(array() as array<struct<first:bigint,last:bigint,size:int>>)),
      (a, r) -> CASE WHEN a.next IS NULL OR r.first >= a.next THEN named_struct('next', r.first + {max_span} + 1, 'out', array_append(a.out, r)) ELSE a END, a -> a.out)"""
    return g.select(*keys, F.inline(F.expr(taken)))


def hash_embedder(dims: int = 64) -> Callable[[list[list[str]]], np.ndarray]:
    """An offline embedder: signed hashing of tokens, normalised."""

    def embed(tokens: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(tokens), dims))
        for i, ts in enumerate(tokens):
            for t in ts:
                h = int(md5(t.encode()).hexdigest()[:8], 16)
                out[i, h % dims] += 1 if h >> 16 & 1 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0)

    return embed


def backfill(records: DataFrame, vectors: DataFrame, embedder: Callable, force: bool = False) -> DataFrame:
    """vectors (id, vec) with those of records (id, tokens) that have none, or of all with `force`."""
    missing = records if force else records.join(vectors.select("id"), "id", "left_anti")

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            yield pd.DataFrame({"id": pdf["id"], "vec": list(embedder([list(t) for t in pdf["tokens"]]))})

    made = missing.select("id", "tokens").mapInPandas(run, vectors.select("id", "vec").schema)
    return upsert(vectors.select("id", "vec"), made, ["id"], ["vec"])
