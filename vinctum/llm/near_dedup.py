"""Near-duplicate documents: SetSketch registers, bands of registers, joint likelihood, exact verification, components.

A document's set: distinct shingles of `k` words, words being runs of anything but ASCII white space, A-Z lower-cased;
with fewer words the whole sequence is the one shingle. Documents are linked at a Jaccard similarity of
`per_hundred` / 100 or more.

Equal sets are one class from the start, so copies cost one row each. Class members meet in 42 bands of 6 registers (a pair at 0.8
misses all of them with a chance below 1 in 300,000). A class is first paired with one least member of its buckets, then
with one of each other component that it meets; pairs that the likelihood allows are verified on the full sets of both texts. Where a bucket
still holds several components, all its pairs across components are put to the likelihood, from registers alone; only rows that it leaves a partner
get their sets and are verified where the bucket is. So no link between components is lost to these stars, while a group of n copies
costs about n pairs. A bucket is split into blocks by its rows and by the bytes of its sets, so that two blocks fit a task.

Null, empty and blank texts have no shingle: linked with nothing, their own component, kept. Rows without doc_id: the
same, with a null component. Rows that share a doc_id are one document for the links: what any of their texts is linked with is in their
component, also if the texts differ. Each row is returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import setsketch
from .arrow import slices, trimmed
from .common import by_size, materialize, without
from .graph import components
from .words import Words, byte_slices

BAND_ROWS = 6
BANDS = setsketch.M // BAND_ROWS
#: Texts are hashed and sketched in slices of about this many bytes.
SLICE_BYTES = 128 << 10
#: Ids of texts to verify are broadcast up to this number (8 bytes each); beyond it they are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Classes of a bucket, and bytes of their sets and registers, in one block; a task compares a block with itself or with one other.
BUCKET_ROWS, BLOCK_BYTES = 4000, 16 << 20
_P = np.uint64(0x9E3779B185EBCA87)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, k: int) -> set:
    w = words(text)
    return set(zip(*(w[i:] for i in range(k)))) if len(w) >= k else {tuple(w)} if w else set()


def shingle_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes, sorted, of the shingles of words given by their hashes."""
    if not len(w):
        return w
    k = min(k, len(w))
    acc = np.full(len(w) - k + 1, np.uint64(k))
    for i in range(k):
        acc = setsketch.mix(acc * _P + w[i : len(w) - k + 1 + i])
    return np.unique(acc)


def _shingles(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of the batches (id, text) with each text's shingle hashes."""
    of = Words()
    for part, texts in byte_slices(batches, 1, SLICE_BYTES):
        h, owner, _ = of.of(texts)
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        yield part, [shingle_hashes(h[s:e], k) for s, e in zip(cuts, cuts[1:])]


def _digest(shingles: bytes) -> bytes:
    return blake2b(shingles, digest_size=16).digest()


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (size of the set), set_hash (null for no set), regs (M little-endian 16-bit registers, null for no set)."""
    schema = "doc_id long, n long, set_hash binary, regs binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _shingles(batches, k):
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            regs, hashes = [None] * len(sets), [None] * len(sets)
            if len(full):
                rows = setsketch.sketch(np.concatenate([sets[i] for i in full]), np.repeat(np.arange(len(full)), sizes[full]), sizes[full])
                for i, r in zip(full, rows):
                    regs[i], hashes[i] = r.astype("<u2").tobytes(), _digest(sets[i].tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(hashes, pa.binary()), pa.array(regs, pa.binary())], names=["doc_id", "n", "set_hash", "regs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), schema)


def _allowed(pairs: DataFrame, reps: DataFrame, per_hundred: int) -> DataFrame:
    """Pairs (a, b) that the registers of both allow."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"r_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").where(f"100 * least(n_a, n_b) >= {per_hundred} * greatest(n_a, n_b)")

    def run(batches):
        for x in batches:
            a, b = (np.frombuffer(b"".join(x.column(c).to_pylist()), "<u2").reshape(x.num_rows, -1) for c in ("r_a", "r_b"))
            ok = setsketch.may_reach((a > b).sum(1), (a < b).sum(1), x.column("n_a").to_numpy().astype(float), x.column("n_b").to_numpy().astype(float), per_hundred / 100) if x.num_rows else np.zeros(0, bool)
            yield x.select(["a", "b"]).filter(pa.array(ok))

    return both.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(trimmed(run), "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, k: int, per_hundred: int, broadcast_ids: int) -> DataFrame:
    """Pairs whose full sets reach the similarity; only texts that are in a pair are moved."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    few = ids.limit(broadcast_ids + 1).count() <= broadcast_ids
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(ids) if few else ids, "id", "left_semi")
    side = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"t_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "t_a", "t_b")

    def run(batches):
        last, held = None, set()
        for part in slices(batches):
            ok = []
            for t_a, t_b in zip(part.column("t_a").to_pylist(), part.column("t_b").to_pylist()):
                if t_a != last:
                    last, held = t_a, shingle_set(t_a, k)
                other = shingle_set(t_b, k)
                common = len(held & other)
                ok.append(bool(other) and 100 * common >= per_hundred * (len(held) + len(other) - common))
            yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(trimmed(run), "a long, b long").distinct()


def _sets(reps: DataFrame, docs: DataFrame, k: int, broadcast_ids: int) -> DataFrame:
    """(rep, set_hash, shingles): the sorted 64-bit hashes of the full sets of the given documents."""
    few = reps.limit(broadcast_ids + 1).count() <= broadcast_ids
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(F.broadcast(reps) if few else reps, "rep", "left_semi")

    def run(batches):
        for part, sets in _shingles(batches, k):
            sets = [s.tobytes() for s in sets]
            hashes = [_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(hashes, pa.binary()), pa.array(sets, pa.binary())], names=["rep", "set_hash", "shingles"])

    return texts.mapInArrow(trimmed(run), "rep long, set_hash binary, shingles binary").dropDuplicates(["rep", "set_hash"])


def _in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each part (key, i, j) of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        part = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")])
        cuts = [0, *(np.flatnonzero((part[:, 1:] != part[:, :-1]).any(axis=0)) + 1), batch.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            if e > s:
                if held and last != tuple(part[:, s]):
                    yield pa.Table.from_batches(held)
                    held.clear()
                last = tuple(part[:, s])
                held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


class _Part:
    """The rows of one part of a bucket, by rep: its blocks i and j, or the one block where i = j."""

    def __init__(self, rows: pa.Table, per_hundred: int):
        self.order = np.argsort(rows.column("rep").to_numpy(), kind="stable")
        self.rep, self.n, self.block = (rows.column(c).to_numpy()[self.order] for c in ("rep", "n", "block"))
        self.comp = np.unique(rows.column("comp").to_numpy()[self.order], return_inverse=True)[1]
        self.regs = np.frombuffer(b"".join(rows.column("regs").to_pylist()), "<u2").reshape(rows.num_rows, -1)[self.order]
        self.key, self.band = rows.column("key")[0].as_py(), rows.column("band")[0].as_py()
        self.split = rows.column("i")[0].as_py() != rows.column("j")[0].as_py()
        self.per_hundred = per_hundred

    def partners(self, x: int, wanted: np.ndarray | None = None) -> np.ndarray:
        """Later rows of other components that the registers allow as links of row x, most alike first; each pair in the first band that it shares."""
        t = self.per_hundred / 100
        n, comp, regs = self.n, self.comp, self.regs
        ok = (comp[x + 1 :] != comp[x]) & (100 * np.minimum(n[x + 1 :], n[x]) >= self.per_hundred * np.maximum(n[x + 1 :], n[x]))
        if self.split:
            ok &= self.block[x + 1 :] != self.block[x]
        if wanted is not None:
            ok &= wanted[x + 1 :]
        ys = np.flatnonzero(ok) + x + 1
        if not len(ys):
            return ys
        alike = regs[ys] == regs[x]
        same = alike.sum(1)
        first = alike.reshape(len(ys), BANDS, BAND_ROWS).all(2).argmax(1) == self.band
        near = first & (same >= (t - 0.2) * setsketch.M)  # far below what may_reach lets pass
        ys, same = ys[near], same[near]
        if not len(ys):
            return ys
        more = (regs[x] > regs[ys]).sum(1)
        fit = setsketch.may_reach(more, setsketch.M - same - more, np.full(len(ys), float(n[x])), n[ys].astype(float), t)
        return ys[fit][np.argsort(-same[fit], kind="stable")]


def _dealt(members: DataFrame) -> DataFrame:
    """members (key, comp, rep, n, ...) with i, j, block: a bucket beyond BUCKET_ROWS or BLOCK_BYTES is split into blocks, and each pair of blocks is a part."""
    weight = F.col("n") * 8 + 2 * setsketch.M
    blocks = members.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BUCKET_ROWS), F.ceil(F.sum(weight) / BLOCK_BYTES)).cast("long").alias("blocks"))
    out = members.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return out.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("blocks", "other")


def _together(members: DataFrame, run, schema: str) -> DataFrame:
    return members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(trimmed(run), schema).distinct()


def _open(members: DataFrame, per_hundred: int) -> DataFrame:
    """(key, rep) of the rows that the registers of some row of another component in their bucket allow; no sets are moved for that."""

    def run(batches):
        for rows in _in_parts(batches):
            part = _Part(rows, per_hundred)
            closed = np.ones(len(part.rep), bool)
            for x in range(len(part.rep) - 1):
                ys = part.partners(x, None if closed[x] else closed)  # a pair of open rows tells nothing new
                if len(ys):
                    closed[x], closed[ys] = False, False
            reps = part.rep[~closed]
            if len(reps):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(reps), part.key)), pa.array(reps)], names=["key", "rep"])

    cols = ["key", "i", "j", "band", "block", "comp", "rep", "n", "regs"]
    return _together(_dealt(members).select(cols), run, "key long, rep long")


def _across(members: DataFrame, sets: DataFrame, per_hundred: int) -> DataFrame:
    """members (key, band, comp, rep, set_hash, n, regs) and their sets -> links (a, b) between components of one bucket, verified on the full sets.

    A row is compared with all rows of other components that it may reach; a link joins the components for the rest of the part, so links found
    are fewer than components, however many pairs there are.
    """

    def links(rows: pa.Table):
        part = _Part(rows, per_hundred)
        column = rows.column("shingles").combine_chunks() if rows.num_rows else None
        sets = [np.frombuffer(column[int(o)].as_buffer(), np.uint64) for o in part.order]
        comp = part.comp
        for x in range(len(sets) - 1):
            for y in part.partners(x).tolist():
                if comp[y] == comp[x]:
                    continue
                a, b = (sets[x], sets[y]) if len(sets[x]) <= len(sets[y]) else (sets[y], sets[x])
                common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                if 100 * common >= per_hundred * (len(a) + len(b) - common):
                    comp[comp == comp[y]] = comp[x]
                    yield int(part.rep[x]), int(part.rep[y])

    def run(batches):
        for rows in _in_parts(batches):
            found = list(links(rows))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    cols = ["key", "i", "j", "band", "block", "comp", "rep", "n", "regs", "shingles"]
    return _together(_dealt(members).join(sets, ["rep", "set_hash"]).select(cols), run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, per_hundred: int = 80, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    rows = materialize(sketches(docs, k), "sketches")
    with_set = rows.where("set_hash IS NOT NULL AND doc_id IS NOT NULL")
    # one row per distinct set; registers are the same for all of them
    reps = materialize(with_set.groupBy("set_hash", "n", "regs").agg(F.min("doc_id").alias("rep")), "classes")
    # texts of one doc_id hang together: a star from the least class of each id that has several
    several = with_set.groupBy("doc_id").agg(F.min("set_hash").alias("s0"), F.max("set_hash").alias("s1")).where("s0 <> s1").select("doc_id")
    named = by_size(with_set.select("doc_id", "set_hash").join(by_size(several, "repeated", broadcast_ids), "doc_id", "left_semi").distinct(), "versions", broadcast_ids)
    named = reps.select("set_hash", "rep").join(named, "set_hash").select("doc_id", "rep")
    tied = named.join(named.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    bands = reps.select("rep", F.posexplode(F.array(*[F.xxhash64(F.lit(i), F.expr(f"substring(regs, {2 * BAND_ROWS * i + 1}, {2 * BAND_ROWS})")) for i in range(BANDS)])).alias("band", "key"))
    shared = bands.groupBy("key").agg(F.min("rep").alias("center"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("size")).where("center < last").drop("last")
    buckets = materialize(bands.join(shared.drop("size"), "key"), "buckets")
    stars = materialize(buckets.where("rep <> center").select("center", "rep").distinct(), "stars")

    def confirm(pairs: DataFrame, name: str) -> DataFrame:
        return materialize(_verified(materialize(pairs, f"{name}-candidates"), docs, k, per_hundred, broadcast_ids), name)

    def component_of(df: DataFrame, col: str, comps: DataFrame) -> DataFrame:
        c = comps.select(F.col("id").alias(col), F.col("component").alias(f"{col}_comp"))
        return df.join(c, col, "left").withColumn(f"{col}_comp", F.coalesce(f"{col}_comp", col))

    # first one center per class: most of a large group of copies hangs together by that
    first = stars.groupBy("rep").agg(F.min("center").alias("a")).select("a", F.col("rep").alias("b"))
    links = materialize(confirm(_allowed(first, reps, per_hundred), "links1").unionByName(tied), "links")
    comps = components(links)
    # then one center per class and other component
    apart = component_of(component_of(stars, "rep", comps), "center", comps).where("rep_comp <> center_comp")
    second = apart.groupBy("rep", "center_comp").agg(F.min("center").alias("a")).select("a", F.col("rep").alias("b"))
    second = second.join(first, ["a", "b"], "left_anti")
    more = confirm(_allowed(second, reps, per_hundred), "links2")
    if more.limit(1).count():
        links = materialize(links.unionByName(more), "links12")
        comps = components(links)
    # buckets that still hold several components: by registers first, then the sets of the rows that these leave
    placed = component_of(buckets.select("key", "band", "rep"), "rep", comps).withColumnRenamed("rep_comp", "comp")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("key")
    inside = materialize(placed.join(mixed, "key"), "mixed").join(reps.select("rep", "set_hash", "n", "regs"), "rep")
    left = materialize(_open(inside, per_hundred), "open")
    sets = _sets(left.select("rep").distinct(), docs, k, broadcast_ids)
    rest = materialize(_across(inside.join(left, ["key", "rep"], "left_semi"), sets, per_hundred), "links3")
    if rest.limit(1).count():
        links = materialize(links.unionByName(rest), "links123")
        comps = components(links)
    classes = reps.select("set_hash", "rep").join(comps, reps["rep"] == comps["id"], "left").select("set_hash", F.coalesce("component", "rep").alias("component"))
    out = rows.select("doc_id", "n", "set_hash").join(classes, "set_hash", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, per_hundred: int = 80) -> DataFrame:
    """The input without the documents that another one of their component stands for."""
    return without(docs, near_duplicates(docs, k, per_hundred).where("NOT kept").select("doc_id"))
