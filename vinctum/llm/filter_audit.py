"""Filter interaction audit: what each of five filters removes alone, after others and in every order, per source.

A document fails A with under 50 words, B if 100 * distinct words < 65 * words, C if 100 * capitals (A-Z) > 5 * characters, D if it holds any of #$%&*|, and
E if its text is identical to that of a smaller doc_id anywhere in the table. Words are runs of anything but ASCII white space, case-sensitive.

E by a counting-Bloom prepass: each task counts its texts' hashes in a sketch of saturating cells, the sketches are merged cell by cell, and
a text one of whose cells was counted once is unique for certain. The others' hashes are counted exactly; only texts whose hash occurs again are read a
second time, and their full texts give the least doc_id. The sketch has 16 cells a row up to MAX_BITS (a bit each when it is sent out, 32 MB at most); past that
size it clears fewer texts and more hashes (not texts) are shuffled.

All else is additive: rows are counted by source, failure mask and labels, and any order's numbers are sums of these counts, as is the Shapley
share: of all orders of the filters, a document of n failures is removed by each of them in one nth.

Null and empty texts are one text of no words and no characters. Null sources count as the empty one. Rows without doc_id are never E's failures nor anybody's
first; rows that share doc_id and text are no repeats of each other. A document is good (or toxic) if any of its label rows says so. Without rows there is no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import trimmed
from .common import by_size, materialize, words_of
from .setsketch import mix

FILTERS = "ABCDE"
_E = 1 << FILTERS.index("E")
#: Cells of the sketch a row, its least and greatest size as powers of two, and cells a text falls on.
CELLS_A_ROW, MIN_BITS, MAX_BITS, HASHES = 16, 16, 28, 3
_SLICE = 1 << 16
#: Bytes of repeated texts' keys (or texts) up to which they are broadcast.
BROADCAST_BYTES = 32 << 20


def text_hashes(text) -> tuple:
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def _named(text) -> list:
    return [h.alias(name) for h, name in zip(text_hashes(text), ("h0", "h1"))]


def flags(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask (of A to D), h0, h1 (two hashes of the text) for every row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text")).withColumn("w", words_of(F.col("text")))
    n, distinct = F.size("w"), F.size(F.array_distinct("w"))
    capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    fails = [n < 50, 100 * distinct < 65 * n, 100 * capitals > 5 * F.length("text"), F.col("text").rlike("[#$%&*|]")]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", mask.cast("int").alias("mask"), *_named(F.col("text")))


def _cells(h: np.ndarray, bits: int) -> np.ndarray:
    """(HASHES, rows) cells of each hash."""
    step = mix(h) | np.uint64(1)
    return np.stack([(mix(h + np.uint64(i) * step) >> np.uint64(64 - bits)).astype(np.int64) for i in range(HASHES)])


def _counted_twice(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bit per cell of the merged sketch: whether more than one text fell on it. Partial sketches are merged on the executors, slice by slice."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << bits, np.uint8)
        for b in batches:
            at = _cells(b.column(0).to_numpy().view(np.uint64), bits)
            at = np.sort(at, axis=0)
            repeat = np.concatenate([np.zeros((1, at.shape[1]), bool), at[1:] == at[:-1]])  # a text counts once on a cell
            place, n = np.unique(at[~repeat], return_counts=True)
            cells[place] = np.minimum(2, cells[place] + np.minimum(n, 2))
        rows = [(i, part.tobytes()) for i, part in enumerate(cells.reshape(-1, min(_SLICE, 1 << bits))) if part.any()]
        for i, raw in rows:
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([pa.compress(raw, codec="zstd", asbytes=True)], pa.binary())], names=["slice", "cells"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, sums = min(_SLICE, 1 << bits), {}
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = np.frombuffer(pa.decompress(raw, decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
                sums[i] = np.minimum(2, sums[i] + part) if i in sums else part
        for i, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.packbits(part > 1).tobytes()], pa.binary())], names=["slice", "twice"])

    rows = hashes.mapInArrow(trimmed(count), "slice int, cells binary").repartition("slice").mapInArrow(trimmed(merge), "slice int, twice binary")
    out = np.zeros((max(1, (1 << bits) // _SLICE), min(_SLICE, 1 << bits) // 8), np.uint8)
    for r in rows.collect():
        out[r["slice"]] = np.frombuffer(r["twice"], np.uint8)
    return out.reshape(-1)


def possible_repeats(rows: DataFrame, bits: int) -> DataFrame:
    """The rows (with h0) whose text the sketch doesn't clear as unique."""
    twice = rows.sparkSession.sparkContext.broadcast(_counted_twice(rows.select("h0"), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _cells(b.column("h0").to_numpy().view(np.uint64), bits)
            yield b.filter(pa.array((twice.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(axis=0)))

    return rows.mapInArrow(trimmed(run), rows.schema)


def later_copies(docs: DataFrame, rows: DataFrame, max_bits: int = MAX_BITS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, part, mask of the rows (of flags) whose full text a smaller doc_id has."""
    n = max(1, rows.count())
    bits = min(max_bits, max(MIN_BITS, (CELLS_A_ROW * n - 1).bit_length()))
    maybe = possible_repeats(rows.where("doc_id IS NOT NULL"), bits)
    again = maybe.groupBy("h0", "h1").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1")).where("d0 < d1").select("h0", "h1")
    again = by_size(again, "repeated-hashes", broadcast_bytes, F.lit(16))
    text = F.coalesce("text", F.lit(""))
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *_named(text))
    least = texts.join(again, ["h0", "h1"], "left_semi").groupBy("text").agg(F.min("doc_id").alias("least"))
    least = materialize(least.select(*_named(F.col("text")), "least", "text"), "least-ids")
    # as good as always one text has a pair of hashes; where two share one, rows are told apart by their full texts
    clash = by_size(least.groupBy("h0", "h1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h0", "h1"), "clashes", broadcast_bytes, F.lit(16))
    plain = by_size(least.join(clash, ["h0", "h1"], "left_anti").select("h0", "h1", "least"), "firsts", broadcast_bytes, F.lit(24))
    out = rows.join(plain, ["h0", "h1"]).where("doc_id > least").select("doc_id", "part", "mask")
    if clash.isEmpty():
        return out
    both = least.join(clash, ["h0", "h1"], "left_semi").select("least", F.col("text").alias("same"))
    told = docs.select("doc_id", "source", "text").join(both, text == F.col("same")).where("doc_id > least")
    return out.unionByName(flags(told).select("doc_id", "part", "mask"))


def mask_counts(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """part, mask (of A to E), good, toxic, n: how many rows have these."""
    rows = materialize(flags(docs), "flags")
    later = materialize(later_copies(docs, rows, **options), "later-copies")
    told = labels.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    told = told.groupBy("doc_id").agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("good", "toxic")]).where("good OR toxic")
    told = by_size(told, "labelled", BROADCAST_BYTES, F.lit(16))
    # a later copy is counted once with E and taken off once without it
    each = rows.select("doc_id", "part", "mask", F.lit(1).alias("n")).unionByName(later.select("doc_id", "part", "mask", F.explode(F.array(F.lit(0), F.lit(_E))).alias("e")).select("doc_id", "part", (F.col("mask") + F.col("e")).alias("mask"), F.when(F.col("e") > 0, 1).otherwise(-1).alias("n")))
    known = each.where("doc_id IS NOT NULL").join(told, "doc_id", "left").select("part", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")], "n")
    nameless = each.where("doc_id IS NULL").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "n")
    return known.unionByName(nameless).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def audit(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: for each part, order and step."""
    counts = materialize(mask_counts(docs, labels, **options), "mask-counts")
    letter = {f: 1 << i for i, f in enumerate(FILTERS)}
    orders = [("".join(p), i + 1, sum(letter[x] for x in p[:i]), letter[f]) for p in permutations(FILTERS) for i, f in enumerate(p)]
    # what a step does depends on its filter and the set of those before it: 80 cases
    cases = sorted({(before, own) for *_, before, own in orders})
    case = F.explode(F.array(*[F.struct(F.lit(b).alias("before"), F.lit(o).alias("own")) for b, o in cases]))
    per = counts.withColumn("case", case).select("part", "mask", "good", "toxic", "n", "case.*")
    sees, fails = "mask & before = 0", "mask & own <> 0"
    total = lambda cond, name, value="n": F.coalesce(F.sum(F.when(F.expr(cond), F.expr(value))), F.lit(0)).cast("long").alias(name)
    sums = per.groupBy("part", "before", "own").agg(
        total("mask & (before | own) = 0", "kept"), total(f"{sees} AND {fails}", "removed"), total(f"mask & before <> 0 AND {fails}", "redundant"), total("mask = own", "unique_fails"),
        total(f"{sees} AND {fails} AND good", "good_lost"), total(f"{sees} AND {fails} AND toxic", "toxic_lost"), total(fails, "shapley", f"n * {len(orders) // len(FILTERS)} div bit_count(mask)"),
    )
    steps = docs.sparkSession.createDataFrame(orders, "filter_order string, step int, before int, own int")  # 600 rows, whatever the data
    return sums.join(F.broadcast(steps), ["before", "own"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
