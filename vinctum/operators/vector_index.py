"""A cell index of vectors: centers fitted on a bounded sample, every row packed into blocks of its cell, exact similarities within the probed cells."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinctum.sources.scratch import materialize, scratch

from .vectors import best_columns, least_ranks, unit_column, unit_rows

#: Rows and bytes of vectors on which centers are fitted, at most; they pass through the driver.
SAMPLE_ROWS, SAMPLE_BYTES = 100_000, 64 << 20
#: Cells at most; their centers are sent to every task.
MAX_CELLS = 16_384
#: Rows of a block; a cell of more rows has several, so a cell that holds a third of all rows is many blocks.
BLOCK_ROWS, QUERY_ROWS = 4096, 1024


@dataclass(frozen=True)
class VectorIndex:
    """blocks: (cell, part, ids, vecs) with unit vectors as doubles; parts: (cell, n_parts), a row a cell; centers: unit vectors."""

    blocks: DataFrame
    parts: DataFrame
    centers: np.ndarray


def _fit(sample: np.ndarray, cells: int, rounds: int, seed: int) -> np.ndarray:
    """Spherical k-means; centers that lose all rows are put on the rows that fit worst."""
    rng = np.random.default_rng(seed)
    centers = sample[rng.choice(len(sample), cells, replace=False)]
    for _ in range(rounds):
        best, near = np.empty(len(sample)), np.empty(len(sample), np.int64)
        for at in range(0, len(sample), 4096):
            sims = sample[at : at + 4096] @ centers.T
            near[at : at + 4096] = sims.argmax(1)
            best[at : at + 4096] = sims.max(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, sample)
        empty = np.flatnonzero(np.bincount(near, minlength=cells) == 0)
        sums[empty] = sample[np.argsort(best, kind="stable")[: len(empty)]]
        centers = unit_rows(sums)
    return centers


def build_index(vectors: DataFrame, cells: int | None = None, rounds: int = 8, seed: int = 7, sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS, path: str | None = None) -> VectorIndex:
    """An index of vectors (id, vec), written to `path` or to the scratch folder; rows without either are left out, all others are in it once.

    The number of cells is 2 sqrt(rows) unless given, at most MAX_CELLS and half the sample. Only fitting the centers takes a sample: rows with the least hashes of their
    ids, sample_rows of them or SAMPLE_BYTES. Zero vectors go to the first cell.
    """
    spark = vectors.sparkSession
    df = vectors.where("id IS NOT NULL AND vec IS NOT NULL").select("id", "vec")
    n = df.count()
    dims = len(df.first()["vec"]) if n else 1
    most = max(1, min(sample_rows, SAMPLE_BYTES // (8 * dims)))
    some = df if n <= most else df.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(-(-n // most))) == 0)
    sample = np.array([r["vec"] for r in some.select("vec").limit(most).collect()], np.float64).reshape(-1, dims)
    cells = max(1, min(cells or round(2 * n**0.5), MAX_CELLS, max(1, len(sample) // 2)))
    centers = _fit(unit_rows(sample), cells, rounds, seed) if len(sample) else np.zeros((1, dims))
    sent = spark.sparkContext.broadcast(centers)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = unit_column(b.column("vec"))
            cell = (v @ sent.value.T).argmax(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cell), b.column("id"), pa.array([r.tobytes() for r in v], pa.binary())], names=["cell", "id", "unit"])

    kind = df.schema["id"].dataType.simpleString()
    placed = materialize(df.mapInArrow(place, f"cell int, id {kind}, unit binary"), "placed")
    path = path or scratch(spark, "vector-index")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("n_parts"))  # a row a cell
    sizes.write.mode("overwrite").parquet(f"{path}/parts")
    parts = spark.read.schema("cell int, n_parts int").parquet(f"{path}/parts")
    dealt = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("n_parts")).cast("int"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (cell, part), ids, units in grouped(batches, ("cell", "part")):
            yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([part], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([b"".join(units.to_pylist())], pa.binary())], names=["cell", "part", "ids", "vecs"])

    blocks = dealt.select("cell", "part", "id", "unit").repartition("cell", "part").sortWithinPartitions("cell", "part", "id").mapInArrow(pack, f"cell int, part int, ids array<{kind}>, vecs binary")
    blocks.write.mode("overwrite").parquet(f"{path}/blocks")
    spark.createDataFrame([(json.dumps(centers.tolist()),)], "centers string").coalesce(1).write.mode("overwrite").text(f"{path}/centers")
    return load_index(spark, path)


def load_index(spark: SparkSession, path: str) -> VectorIndex:
    centers = np.array(json.loads(spark.read.text(f"{path}/centers").first()["value"]))
    return VectorIndex(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/parts"), centers)


def grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, str]):
    """(key, ids, units) of runs of equal keys in sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        key = np.stack([b.column(k).to_numpy() for k in keys])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            if e > s:
                now = tuple(key[:, s].tolist())
                if held and now != last:
                    t = pa.Table.from_batches(held).combine_chunks()
                    yield last, t.column("id").chunk(0), t.column("unit").chunk(0)
                    held = []
                last = now
                held.append(b.slice(s, e - s))
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield last, t.column("id").chunk(0), t.column("unit").chunk(0)


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int = 16, threshold: float | None = None) -> DataFrame:
    """(query_id, id, similarity, rank): the k most similar rows of the `probes` cells nearest to each query, similarities exact, ties to the least id.

    Queries travel to the blocks of their cells, packed; blocks of other cells are not multiplied. With as many probes as cells the result is that of an exact search.
    """
    sent = queries.sparkSession.sparkContext.broadcast(index.centers)
    q_kind, kind = queries.schema["id"].dataType.simpleString(), index.blocks.schema["ids"].dataType.elementType.simpleString()
    probes = min(probes, len(index.centers))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = unit_column(b.column("vec"))
            if len(v):
                cells = np.argsort(-(v @ sent.value.T), axis=1, kind="stable")[:, :probes]
                at = np.repeat(np.arange(len(v)), probes)
                yield pa.RecordBatch.from_arrays([pa.array(cells.ravel().astype(np.int32)), b.column("id").take(pa.array(at)), pa.array([v[i].tobytes() for i in at], pa.binary())], names=["cell", "id", "unit"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (cell, part), ids, units in grouped(batches, ("cell", "part")):
            for at in range(0, len(ids), QUERY_ROWS):
                few = ids.slice(at, QUERY_ROWS)
                few = pa.concat_arrays([few])
                yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([part], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(few)], pa.int32()), few), pa.array([b"".join(units.slice(at, QUERY_ROWS).to_pylist())], pa.binary())], names=["cell", "part", "q_ids", "q_vecs"])

    asked = queries.where("id IS NOT NULL AND vec IS NOT NULL").select("id", "vec").mapInArrow(probe, f"cell int, id {q_kind}, unit binary")
    asked = asked.join(F.broadcast(index.parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
    asked = asked.select("cell", "part", "id", "unit").repartition("cell", "part").sortWithinPartitions("cell", "part").mapInArrow(pack, f"cell int, part int, q_ids array<{q_kind}>, q_vecs binary")
    both = index.blocks.join(asked, ["cell", "part"]).select("q_ids", "q_vecs", "ids", "vecs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                q_ids, ids = b.column("q_ids")[i].values, b.column("ids")[i].values
                q, v = (np.frombuffer(b.column(c)[i].as_py()).reshape(len(x), -1) for c, x in (("q_vecs", q_ids), ("vecs", ids)))
                sims = q @ v.T  # columns in the order of ids
                row, col = best_columns(sims, k)
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(row)), ids.take(pa.array(col)), pa.array(sims[row, col])], names=["query_id", "id", "similarity"])

    return least_ranks(both.mapInArrow(run, f"query_id {q_kind}, id {kind}, similarity double"), k, threshold)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact search's pairs (query_id, id) that were found; equal similarities count as found."""
    need = exact.groupBy("query_id").agg(F.count(F.lit(1)).alias("need"), F.min("similarity").alias("least"))
    got = found.join(need, "query_id").where(F.round("similarity", 12) >= F.round("least", 12)).groupBy("query_id").agg(F.least(F.count(F.lit(1)), F.first("need")).alias("got"))
    row = need.join(got, "query_id", "left").agg((F.sum(F.coalesce("got", F.lit(0))) / F.sum("need")).alias("r")).first()
    return float(row["r"]) if row["r"] is not None else 1.0
