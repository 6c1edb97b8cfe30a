"""Substring dedup by fixed-block anchors: passages of `window` or more words that also stand elsewhere are cut from texts.

Words are runs of anything but ASCII white space, unchanged. A window is `window` consecutive words of one text; it is repeated if the same words
also start anywhere else, in the same text too. All words of repeated windows go, every occurrence of them; windows are judged on the input.

Each text is cut into reference blocks that don't overlap, of BLOCK = (window + 1) // 2 words, so that every window holds a whole one. The
index is of these blocks; every rolling run of BLOCK words probes it. Where a reference block and another run are equal both are anchors. Around anchors hits are
extended to the windows that hold them, at most window - BLOCK words to either side; those windows are compared by two independent
polynomial hashes of their words (64 bits and the bucket's; 128 within a chunk), and the union of the repeated ones are the maximal exact repeats. Blocks are
compared by 32 bits and the bucket's: an anchor too many costs some questions, no result.

Texts are packed once into chunks of about CHUNK_BYTES bytes with a fixed number each, dealt by it into a bucketed table, so that answers come to the chunks
and the texts move once. A chunk asks once for each distinct run, with the place of
one occurrence: a run that it holds several times is an anchor (or a repeated window) anyway. So copies cost one question a chunk, however many
there are, and no group of copies ever meets in one task. Questions travel packed by bucket of hashes; only places of hits come back.

Null, empty and blank texts have no words; texts of fewer than `window` words lose none. Rows are texts of their own: rows that are equal in all columns are
copies and both lose what they share. Rows without doc_id take part. Long texts are a chunk of their own. Other columns pass through `cut`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import trimmed
from .common import SPACE_CHARS, SPACE_CLASS, bucketed, by_size, fresh, words_of
from .setsketch import mix
from .words import Words, byte_slices

WINDOW = 35
#: Bytes of text of a chunk, about, or one text.
CHUNK_BYTES = 4 << 20
#: Questions that a bucket gathers, on average.
BUCKET_ROWS = 1_000_000
#: Bytes of text whose words are hashed at once.
PIECE_BYTES = 512 << 10
_SPACE = re.compile(rb"[ \t-\r]")
_NONE = 0xFFFFFFFF
_GOLD = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def _chunks(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """(chunk, doc_ids, k0, k1, texts): whole rows in packs; k0 and k1 are two hashes of doc_id and text, which `cut` joins by."""
    names = ["doc_ids", "k0", "k1", "size", "texts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in byte_slices(batches, 3, chunk_bytes):
            n = sum(len(t) for t in texts)
            lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(i)) for i in range(3)]
            sizes = pa.array([[len(t) for t in texts]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*lists, sizes, pa.array([pa.compress(b"".join(texts), codec="zstd", asbytes=True) if n else b""], pa.binary())], names=names)

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text"), F.xxhash64("text", F.lit(1), "doc_id"), "text")
    return rows.mapInArrow(trimmed(run), "doc_ids array<long>, k0 array<long>, k1 array<long>, size array<long>, texts binary").withColumn("chunk", F.monotonically_increasing_id())


def _texts(row: dict) -> list[bytes]:
    total = sum(row["size"])
    raw = pa.decompress(row["texts"], decompressed_size=total, codec="zstd", asbytes=True) if total else b""
    ends = np.cumsum([0, *row["size"]]).tolist()
    return [raw[s:e] for s, e in zip(ends, ends[1:])]


def _pieces(texts: list[bytes], most: int = PIECE_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """(number of the text, bytes) in groups of about `most` bytes; long texts are parted at white space."""
    held, size = [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text) or not text:
            end = len(text)
            if end - at > most and (m := _SPACE.search(text, at + most)):
                end = m.start()
            held.append((i, text[at:end]))
            size += end - at
            at = end
            if size >= most:
                yield held
                held, size = [], 0
            if not text:
                break
    if held:
        yield held


class Runs:
    """Hashes of runs of consecutive words of one text, for all texts of a chunk."""

    def __init__(self, texts: list[bytes], hasher: Words):
        found = []
        for group in _pieces(texts):
            h, piece, _ = hasher.of([b for _, b in group])
            found.append((h, np.array([i for i, _ in group])[piece]))
        self.hash, owner = (np.concatenate(x) for x in zip(*found))
        self.cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        n = len(self.hash)
        self.room = self.cuts[1:][owner] - np.arange(n)  # words from here to the text's end
        self.place = np.arange(n) - self.cuts[:-1][owner]
        self.sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, starts: np.ndarray, words: int, which: int = 0) -> np.ndarray:
        """64-bit hashes of the runs of so many words that begin at `starts`."""
        if which not in self.sums:
            n, p = len(self.hash), _GOLD[which]
            up, down = np.full(n + 1, p, np.uint64), np.full(n + 1, pow(p, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            up, down = np.cumprod(up), np.cumprod(down)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((self.hash ^ np.uint64(which)) * up[:n], out=sums[1:])
            self.sums[which] = sums, down
        sums, down = self.sums[which]
        return mix((sums[starts + words] - sums[starts]) * down[starts])


def _several(key: np.ndarray, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, start of each group in it, size of each group) of equal keys."""
    order = np.argsort(key, kind="stable") if second is None else np.lexsort((second, key))
    k = key[order]
    new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    if second is not None and len(k):
        s = second[order]
        new[1:] |= s[1:] != s[:-1]
    begin = np.flatnonzero(new)
    return order, begin, np.diff(np.append(begin, len(k)))


def _narrow(place: np.ndarray, flags: np.ndarray | None = None) -> bytes:
    """Ascending places (and flags) in few bytes: their steps, the low bytes first."""
    steps = np.diff(place.astype(np.int64), prepend=0).astype("<u4")
    body = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes() + (b"" if flags is None else flags.astype("<u1").tobytes())
    return pa.compress(body, codec="zstd", asbytes=True)


def _widened(raw: bytes, m: int, flags: bool = False) -> tuple[np.ndarray, np.ndarray]:
    body = pa.decompress(raw, decompressed_size=(4 + flags) * m, codec="zstd", asbytes=True)
    steps = np.ascontiguousarray(np.frombuffer(body, np.uint8, 4 * m).reshape(4, m).T).view("<u4").ravel()
    return np.cumsum(steps.astype(np.int64)) & _NONE, np.frombuffer(body, np.uint8, m, 4 * m) if flags else np.zeros(0, np.uint8)


def _packed(chunk: int, buckets: int, bucket: np.ndarray, place: np.ndarray, flags: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch | None:
    """One row per bucket: the questions of a chunk; place is _NONE where no answer is needed."""
    if not len(bucket):
        return None
    order = np.lexsort((place, bucket))
    bucket, place, flags, hashes = bucket[order], place[order], flags[order], hashes[order]
    cuts = [*np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist(), len(bucket)]
    rows = []
    for s, e in zip(cuts, cuts[1:]):
        rows.append((int(bucket[s]), chunk, e - s, _narrow(place[s:e], flags[s:e]), hashes[s:e].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "chunk", "rows", "places", "hashes"])


_ASKED = "bucket long, chunk long, rows int, places binary, hashes binary"


def _answers(asked: DataFrame, kind: str, blocks: bool) -> DataFrame:
    """(chunk, n, places): the places asked for whose run occurs elsewhere; blocks: and is a reference block somewhere. kind: of the hashes."""

    def found(held: list[tuple]):
        key, place, flags, owner = [], [], [], []
        for i, (_, m, body, raw) in enumerate(held):
            at, mark = _widened(body, m, True)
            place.append(at)
            flags.append(mark)
            key.append(np.frombuffer(raw, kind, m))
            owner.append(np.full(m, i))
        key, place, flags, owner = (np.concatenate(x) for x in (key, place, flags, owner))
        order, begin, size = _several(key)
        flags = flags[order]
        hit = np.add.reduceat(1 + (flags & 1), begin) >= 2  # bit 0: the chunk holds it several times
        if blocks:
            hit &= np.bitwise_or.reduceat(flags, begin) & 2 > 0  # bit 1: it is a reference block
        hit = np.repeat(hit, size)
        on = order[hit & (place[order] != _NONE)]
        on = on[np.lexsort((place[on], owner[on]))]
        cuts = np.searchsorted(owner[on], np.arange(len(held) + 1))
        rows = [(held[i][0], e - s, _narrow(place[on[s:e]])) for i, (s, e) in enumerate(zip(cuts, cuts[1:])) if e > s]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary()))], names=["chunk", "n", "places"])

    def run(batches):
        held, last = [], None
        for b in batches:
            for bucket, *row in zip(*(b.column(x).to_pylist() for x in ("bucket", "chunk", "rows", "places", "hashes"))):
                if bucket != last and held:
                    yield from found(held)
                    held = []
                last = bucket
                held.append(row)
        if held:
            yield from found(held)

    return asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(run), "chunk long, n int, places binary")


def _with_places(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """The chunks with all their answered places; the chunks stay where they are."""
    per = answers.groupBy("chunk").agg(F.collect_list(F.struct("n", "places")).alias("places"))  # a chunk's, at most its words
    return chunks.join(per.hint("shuffle_hash"), "chunk", "left")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def _places(row: dict) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(_widened(p["places"], p["n"])[0] for p in row["places"] or [])])


def _blocks(window: int) -> int:
    return (window + 1) // 2


def _probes(chunks: DataFrame, window: int, buckets: int) -> DataFrame:
    """Questions for all rolling runs of a block's words, reference blocks marked."""
    block = _blocks(window)

    def run(batches):
        hasher = Words(fold=False)
        for row in _rows(batches):
            runs = Runs(_texts(row), hasher)
            at = np.flatnonzero((runs.room >= block) & (runs.room + runs.place >= window))
            h = runs.of(at, block)
            order, begin, size = _several(h)
            if not len(begin):
                continue
            mark = np.where(runs.place[at] % block == 0, 2, 0)[order]
            flags = np.bitwise_or.reduceat(mark, begin) | (size > 1)
            first = order[begin]
            out = _packed(row["chunk"], buckets, _bucket(h[first], buckets), np.where(size > 1, _NONE, at[first]), flags, h[first].astype("<u4"))
            if out is not None:
                yield out

    return chunks.select("chunk", "size", "texts").mapInArrow(trimmed(run), _ASKED)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """From the high bits, of which questions about blocks carry none."""
    return (mix(h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _anchored(runs: Runs, window: int, asked: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold an anchor: one of those asked for, or a run that the chunk itself holds several times."""
    block = _blocks(window)
    at = np.flatnonzero((runs.room >= block) & (runs.room + runs.place >= window))
    order, begin, size = _several(runs.of(at, block))
    own = at[order[np.repeat(size > 1, size)]]
    n = len(runs.hash)
    anchors = np.zeros(n, bool)
    anchors[own] = anchors[asked] = True
    anchors = np.flatnonzero(anchors)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.maximum(anchors - (window - block), anchors - runs.place[anchors]), 1)
    np.add.at(change, anchors + 1, -1)
    return np.flatnonzero((np.cumsum(change)[:n] > 0) & (runs.room >= window))


def _extended(chunks: DataFrame, window: int, buckets: int) -> DataFrame:
    """Questions for the windows around anchors."""

    def run(batches):
        hasher = Words(fold=False)
        for row in _rows(batches):
            runs = Runs(_texts(row), hasher)
            at = _anchored(runs, window, _places(row))
            h, g = runs.of(at, window), runs.of(at, window, 1)
            order, begin, size = _several(h, g)
            if not len(begin):
                continue
            first = order[begin]
            out = _packed(row["chunk"], buckets, _bucket(g[first], buckets), np.where(size > 1, _NONE, at[first]), (size > 1).astype(np.int64), h[first].astype("<u8"))
            if out is not None:
                yield out

    return chunks.select("chunk", "size", "texts", "places").mapInArrow(trimmed(run), _ASKED)


def _covered(runs: Runs, window: int, asked: np.ndarray) -> np.ndarray:
    """Whether each word lies in a repeated window: one of those asked for, or one that the chunk itself holds several times."""
    n = len(runs.hash)
    at = np.flatnonzero(runs.room >= window)
    order, begin, size = _several(runs.of(at, window))
    some = at[order[np.repeat(size > 1, size)]]
    order, begin, size = _several(runs.of(some, window), runs.of(some, window, 1))
    starts = np.unique(np.concatenate([some[order[np.repeat(size > 1, size)]], asked]))
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return np.cumsum(change)[:n] > 0


def _judged(docs: DataFrame, window: int, chunk_bytes: int) -> DataFrame:
    """(chunk, doc_ids, k0, k1, size, texts, places): the chunks with the starts of their repeated windows."""
    spark = docs.sparkSession
    chunks = bucketed(_chunks(docs, chunk_bytes), "chunk", int(spark.conf.get("spark.sql.shuffle.partitions")), "chunks")
    words = int(chunks.agg(F.sum(F.aggregate("size", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0) // 6
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), words // BUCKET_ROWS)
    anchored = _with_places(chunks, _answers(_probes(chunks, window, buckets), "<u4", True))
    return _with_places(chunks, _answers(_extended(anchored, window, buckets), "<u8", False))


def repeats(docs: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, k0, k1, n_words, n_removed, kept_sha256, spans array<struct<first,end>> (of words, end exclusive) for every row."""
    schema = "doc_id long, k0 long, k1 long, n_words long, n_removed long, kept_sha256 string, spans array<struct<first:int,end:int>>"
    spans_type = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        hasher = Words(fold=False)
        for row in _rows(batches):
            texts = _texts(row)
            runs = Runs(texts, hasher)
            gone = _covered(runs, window, _places(row))
            out = []
            for i, text in enumerate(texts):
                mine = gone[runs.cuts[i] : runs.cuts[i + 1]]
                w = text.split()
                edge = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8))).tolist()
                kept = [x for x, g in zip(w, mine.tolist()) if not g] if edge else w
                out.append((row["doc_ids"][i], row["k0"][i], row["k1"][i], len(w), len(w) - len(kept), sha256(b" ".join(kept)).hexdigest(), [{"first": s, "end": e} for s, e in zip(edge[::2], edge[1::2])]))
            types = (*[pa.int64()] * 5, pa.string(), spans_type)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["doc_id", "k0", "k1", "n_words", "n_removed", "kept_sha256", "spans"])

    return _judged(docs, window, chunk_bytes).mapInArrow(trimmed(run), schema)


def cut(docs: DataFrame, window: int = WINDOW, max_rows: int = 1_000_000, **options) -> DataFrame:
    """The input's columns; texts that lose words are their other words, joined by one space. n_chars follows. No row goes."""
    k0, k1, spans, left = fresh(docs, "k0", "k1", "spans", "left")
    lost = repeats(docs, window, **options).where(F.size("spans") > 0).select(F.col("k0").alias(k0), F.col("k1").alias(k1), F.col("spans").alias(spans)).dropDuplicates([k0, k1])
    lost = by_size(lost, "repeated", max_rows, F.size(spans))
    joined = docs.join(lost, (F.xxhash64(docs["doc_id"], docs["text"]) == F.col(k0)) & (F.xxhash64(docs["text"], F.lit(1), docs["doc_id"]) == F.col(k1)), "left")
    kept = F.filter(words_of(docs["text"], SPACE_CLASS, SPACE_CHARS), lambda _, i: ~F.exists(spans, lambda s: (s["first"] <= i) & (i < s["end"])))
    joined = joined.withColumn(left, F.when(F.col(spans).isNull(), docs["text"]).otherwise(F.array_join(kept, " ")))
    new = {"text": F.col(left)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length(left).cast(docs.schema["n_chars"].dataType))
    return joined.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
