"""Centroid clustering of integer vectors by the Shallot search: Lloyd's rounds with the same result, but few distances computed.

Each vector remembers its centroid, its second-nearest one, an upper bound of its distance to the first and a lower bound to all others. After
the centroids have moved, bounds move with them; a vector whose upper bound lies below its lower one, or below half the gap to the next
centroid, stays. Of the others the distances to both remembered centroids are taken, the search starts at the closer one, walks that one's neighbours in the
order of their gaps and ends where a gap exceeds the ball, which shrinks with each closer centroid found. Survivors are compared in exact integers; bounds
are floats, rounded outwards. Ties go to the smaller number.

A component x becomes floor(scale * x). Kept are vectors of exactly `dims` components, none null or not finite; others have no row in the result. Start centroids are the k
vectors whose sha256 of `seed:vec_id` is least (equal ids: by their components; vectors without an id come last, but take part). With fewer vectors than k there are as many
centroids as vectors; an empty table gives an empty result. Rows that repeat are vectors of their own. Components beyond 2**27 after scaling are computed
in Python's integers; a distance or a sum beyond a long is given as the greatest long. Other columns are not read.

Vectors are packed once into blocks, dealt by block and kept on disk; per round only the state (12 bytes a vector) is written and joined to
them, and k sums of a task's vectors travel. The driver holds the centroids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import trimmed
from .common import materialize

#: Vectors of a block.
BLOCK_ROWS = 4096
#: Components up to this are computed in 64-bit integers: 64 squares of their differences stay below 2**62.
LARGE = 1 << 27
_MOST = (1 << 63) - 1
_UP, _DOWN = 1 + 1e-6, 1 - 1e-6
_STATE = "block long, best binary, second binary, upper binary, lower binary, sums array<string>, counts array<long>"


def _integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as 64-bit integers, or as Python's where they could get too large."""
    if not x.size or np.abs(x).max() * scale < LARGE:
        return np.floor(x * scale).astype(np.int64)
    return np.array([[math.floor(v * scale) if abs(v) < 2.0**52 else int(v) * scale for v in row] for row in x.tolist()], object).reshape(x.shape)


def _to_bytes(v: np.ndarray) -> tuple[int, bytes]:
    """(bytes a component, or 0 for decimal numbers; the components)"""
    if v.dtype == object:
        return 0, ",".join(map(str, v.ravel())).encode()
    width = 2 if not v.size or np.abs(v).max() < 1 << 15 else 4
    return width, v.astype(f"<i{width}").tobytes()


def _from_bytes(width: int, raw: bytes, dims: int) -> np.ndarray:
    if width:
        return np.frombuffer(raw, f"<i{width}").astype(np.int64).reshape(-1, dims)
    return np.array([int(v) for v in raw.split(b",")], object).reshape(-1, dims)


def _packed(vectors: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """(ids, width, data): blocks of the vectors that are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                vec = batch.column(1)
                size = pc.fill_null(pc.list_value_length(vec), -1).to_numpy(zero_copy_only=False)
                begin = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
                flat = vec.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
                full = np.flatnonzero(size == dims)
                x = flat[begin[full][:, None] + np.arange(dims)] if len(full) else np.zeros((0, dims))
                on = np.isfinite(x).all(1)
                x, full = x[on], full[on]
                wide = np.abs(x).max(1, initial=0) * scale >= LARGE
                for part in (~wide, wide):
                    if part.any():
                        width, raw = _to_bytes(_integers(x[part], scale))
                        ids = batch.column(0).take(pa.array(full[part]))
                        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([width], pa.int32()), pa.array([raw], pa.binary())], names=["ids", "width", "data"])

    return vectors.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{vec_col}`")).mapInArrow(trimmed(run), "ids array<long>, width int, data binary")


def _starts(blocks: DataFrame, k: int, seed: int, dims: int) -> list[list[int]]:
    def run(batches):
        for batch in batches:
            for ids, width, raw in zip(*(batch.column(c).to_pylist() for c in ("ids", "width", "data"))):
                v = _from_bytes(width, raw, dims)
                hashes = [None if i is None else sha256(f"{seed}:{i}".encode()).hexdigest() for i in ids]
                rows = sorted(range(len(ids)), key=lambda i: (hashes[i] is None, hashes[i] or "", ",".join(map(str, v[i].tolist()))))[:k]
                yield pa.RecordBatch.from_arrays([pa.array([hashes[i] for i in rows], pa.string()), pa.array([",".join(map(str, v[i].tolist())) for i in rows], pa.string())], names=["hash", "vec"])

    rows = blocks.mapInArrow(trimmed(run), "hash string, vec string").orderBy(F.asc_nulls_last("hash"), "vec").limit(k).collect()
    return [[int(x) for x in r["vec"].split(",")] for r in rows]


def _root(n: int) -> float:
    try:
        return math.sqrt(n)
    except OverflowError:
        return math.inf


def _gaps(cents: list[list[int]]) -> np.ndarray:
    return np.array([[_root(sum((x - y) ** 2 for x, y in zip(a, b))) for b in cents] for a in cents])


class Round:
    """What every task of a round needs: the centroids, their gaps and neighbours, and how far they have moved."""

    def __init__(self, cents: list[list[int]], moves: list[float] | None = None):
        self.wide = any(abs(v) > LARGE for c in cents for v in c)
        self.cents = np.array(cents, object if self.wide else np.int64)
        k = len(cents)
        self.gaps = _gaps(cents)
        self.order = np.argsort(self.gaps, axis=1, kind="stable")
        self.half = np.array([min((self.gaps[i, j] for j in range(k) if j != i), default=math.inf) / 2 for i in range(k)]) * _DOWN
        self.moves = np.array(moves if moves is not None else [0.0] * k) * _UP
        self.others = np.array([max((self.moves[j] for j in range(k) if j != i), default=0.0) for i in range(k)])

    def squared(self, x: np.ndarray, to: np.ndarray | int) -> np.ndarray:
        d = x - self.cents[to]
        return (d * d).sum(1)

    def scan(self, x: np.ndarray):
        """(best, second, squared distances to both) of rows by all centroids."""
        k = len(self.cents)
        best, second = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        d1 = self.squared(x, 0)
        d2 = None
        for j in range(1, k):
            d = self.squared(x, j)
            first = (d < d1).astype(bool)
            if d2 is None:
                second, d2 = np.where(first, 0, j), np.where(first, d1, d)
            else:
                next_ = ~first & (d < d2).astype(bool)
                second, d2 = np.where(first, best, np.where(next_, j, second)), np.where(first, d1, np.where(next_, d, d2))
            best, d1 = np.where(first, j, best), np.where(first, d, d1)
        return best, second, d1, d2

    def search(self, x: np.ndarray, best: np.ndarray, second: np.ndarray, d1: np.ndarray, d2: np.ndarray):
        """The same from two known centroids each, of which `best` is the closer one, within shrinking balls."""
        start, radius = best.copy(), np.sqrt(d1.astype(float))
        one, two = best.copy(), second.copy()  # distances to these are known
        for m in np.unique(start).tolist():
            live = np.flatnonzero(start == m)
            for j in self.order[m].tolist():
                if j == m:
                    continue
                # whatever is among the two nearest lies within this ball around m
                live = live[self.gaps[m, j] <= (radius[live] + np.sqrt(d2[live].astype(float))) * _UP]
                if not len(live):
                    break
                todo = live[(one[live] != j) & (two[live] != j)]
                if not len(todo):
                    continue
                d = self.squared(x[todo], j)
                first = (d < d1[todo]) | ((d == d1[todo]) & (j < best[todo]))
                second_ = ~first & ((d < d2[todo]) | ((d == d2[todo]) & (j < second[todo])))
                a, b = todo[first], todo[second_]
                second[a], d2[a] = best[a], d1[a]
                best[a], d1[a] = j, d[first]
                second[b], d2[b] = j, d[second_]
        return best, second, d1, d2

    def assign(self, x: np.ndarray, state: tuple[np.ndarray, ...] | None):
        """(best, second, upper, lower) of a block's rows."""
        n, k = len(x), len(self.cents)
        if k == 1:
            return np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.full(n, np.inf)
        if x.dtype == object or self.wide:
            best, second, _, _ = self.scan(x.astype(object))
            return best, second, np.full(n, np.inf), np.zeros(n)
        if state is None:
            best, second, d1, d2 = self.scan(x)
            return best, second, np.sqrt(d1.astype(float)) * _UP, np.sqrt(d2.astype(float)) * _DOWN
        best, second, upper, lower = (a.copy() for a in state)
        upper, lower = (upper + self.moves[best]) * _UP, np.maximum(0, (lower - self.others[best]) * _DOWN)
        safe = np.maximum(lower, self.half[best])
        open_ = np.flatnonzero(~(upper < safe))
        d1 = self.squared(x[open_], best[open_])
        upper[open_] = np.sqrt(d1.astype(float)) * _UP
        left = ~(upper[open_] < safe[open_])
        open_, d1 = open_[left], d1[left]
        if len(open_):
            a, b = best[open_], second[open_]
            d2 = self.squared(x[open_], b)
            swap = (d2 < d1) | ((d2 == d1) & (b < a))
            found = self.search(x[open_], np.where(swap, b, a), np.where(swap, a, b), np.where(swap, d2, d1), np.where(swap, d1, d2))
            best[open_], second[open_] = found[0], found[1]
            upper[open_], lower[open_] = np.sqrt(found[2].astype(float)) * _UP, np.sqrt(found[3].astype(float)) * _DOWN
        return best, second, upper, lower

    def sums(self, x: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per centroid: sum of its vectors, exactly, and their number."""
        k = len(self.cents)
        counts = np.bincount(best, minlength=k)
        if x.dtype == object:
            return np.array([[sum(col) for col in zip(*x[best == j])] or [0] * x.shape[1] for j in range(k)], object), counts
        one = (best[None, :] == np.arange(k)[:, None]).astype(float)
        return (one @ x.astype(float)).astype(np.int64), counts  # at most 2**27 * 2**12: exact in doubles


def _rows(batches: Iterator[pa.RecordBatch], dims: int):
    """(block, ids, vectors, state or None) of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names if c != "ids"}
            state = None
            if row.get("best") is not None:
                state = (np.frombuffer(row["best"], "<u2").astype(np.int64), np.frombuffer(row["second"], "<u2").astype(np.int64), np.frombuffer(row["upper"], "<f4").astype(float), np.frombuffer(row["lower"], "<f4").astype(float))
            yield row["block"], batch.column("ids")[i].values, _from_bytes(row["width"], row["data"], dims), state


def _step(rows: DataFrame, now: Round, dims: int) -> DataFrame:
    """The next state of each block, with the sums of its vectors by centroid."""

    def run(batches):
        for block, _, x, state in _rows(batches, dims):
            best, second, upper, lower = now.assign(x, state)
            sums, counts = now.sums(x, best)
            raw = [best.astype("<u2").tobytes(), second.astype("<u2").tobytes(), (upper * _UP).astype("<f4").tobytes(), (lower * _DOWN).astype("<f4").tobytes()]
            text = [",".join(map(str, s.tolist())) for s in sums]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([r], pa.binary()) for r in raw), pa.array([text], pa.list_(pa.string())), pa.array([counts.tolist()], pa.list_(pa.int64()))], names=["block", "best", "second", "upper", "lower", "sums", "counts"])

    return rows.mapInArrow(trimmed(run), _STATE)


def _means(state: DataFrame, cents: list[list[int]]) -> list[list[int]]:
    """Componentwise floor of each centroid's mean; an empty one stays. k rows reach the driver."""
    k, dims = len(cents), len(cents[0])

    def total(rows, width):
        sums, counts = {}, {}
        for j, n, text in rows:
            if n:
                counts[j] = counts.get(j, 0) + n
                sums[j] = [a + int(b) for a, b in zip(sums.get(j, [0] * width), text.split(","))]
        return [(j, counts[j], ",".join(map(str, sums[j]))) for j in sorted(sums)]

    names = ["cluster", "n", "total"]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.string()))], names=names)

    def part(batches):
        rows: list = []
        for b in batches:
            for counts, sums in zip(b.column("counts").to_pylist(), b.column("sums").to_pylist()):
                rows = total([*rows, *zip(range(k), counts, sums)], dims)
        yield batch(rows)

    def merge(batches):
        rows: list = []
        for b in batches:
            rows = total([*rows, *zip(*(b.column(c).to_pylist() for c in names))], dims)
        yield batch(rows)

    schema = "cluster int, n long, total string"
    found = state.select("counts", "sums").mapInArrow(trimmed(part), schema).repartition("cluster").mapInArrow(trimmed(merge), schema).collect()
    out = [list(c) for c in cents]
    for r in found:
        out[r["cluster"]] = [int(v) // r["n"] for v in r["total"].split(",")]
    return out


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance) per kept vector, the final centroids). k is 65,535 at most."""
    blocks = _packed(vectors, id_col, vec_col, dims, scale).withColumn("block", F.monotonically_increasing_id())
    blocks = materialize(blocks, "vectors")  # numbers of blocks are fixed from here on
    cents = _starts(blocks, k, seed, dims)
    if not cents:
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), []
    n = blocks.count()
    parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 64)
    placed = blocks.repartition(parts, "block").persist(StorageLevel.DISK_ONLY)
    state, now = None, Round(cents)
    with_state = lambda: placed if state is None else placed.join(state.drop("sums", "counts").hint("shuffle_hash"), "block")
    for _ in range(rounds):
        state = materialize(_step(with_state(), now, dims), "bounds")
        means = _means(state, cents)
        moves = [_root(sum((a - b) ** 2 for a, b in zip(x, y))) for x, y in zip(cents, means)]
        cents, now = means, Round(means, moves)
        if not any(moves):  # all further rounds would repeat this one
            break

    def run(batches):
        for _, ids, x, old in _rows(batches, dims):
            best = now.assign(x, old)[0]
            d = now.squared(x.astype(object) if now.wide else x, best)
            d = np.minimum(d, _MOST).astype(np.int64) if d.dtype == object else d
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(best.astype(np.int32)), pa.array(d)], names=["vec_id", "cluster", "distance"])

    out = materialize(with_state().mapInArrow(trimmed(run), "vec_id long, cluster int, distance long"), "clusters")
    placed.unpersist()
    return out, cents


def report(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 per kept vector."""
    rows, cents = cluster(vectors, **options)
    far = {r["cluster"]: int(r["d"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    whole = min(sum(far.values()), _MOST)
    facts = [(j, min(far[j], _MOST), whole, sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(cents) if j in far]
    facts = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
