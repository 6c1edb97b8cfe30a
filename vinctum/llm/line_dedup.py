"""Line dedup by an exact set-similarity join: rarity order, prefix, positional, length and bitmap filters, verified Jaccard.

A line (text between \\n) is its set of distinct words: runs of anything but ASCII white space, A-Z lower-cased. Lines match at a
Jaccard similarity of `per_hundred` / 100 or more. Order is by doc_id, then by place in the text, then by a hash of the text. A line is
removed if any earlier line matches it, whether or not that one is itself removed; so a later copy always goes and a first one always
stays. Every line with a word is compared (`min_words` can raise that).

Equal sets are one class with one first place; classes are numbered in the order of these places. Rarity comes from a fixed
number of counters that cover every word of every text; any fixed order gives the same result, a good one only spares work. A class is
posted under the rarest words of its prefix, unless it is so short that only an equal set can match it (up to 3 words at 0.8;
4 words match 5); words counted once are left out, as nobody can share them. Postings travel packed, a bucket of words at a time. A list
of more than LIST_ROWS postings is dealt in blocks, each pair of blocks to a part of its own. Of each later class a list gives the BEST
most alike earlier ones that pass the filters, and these are verified; a class that had more in a list, none of them confirmed,
is asked for in a second round that compares it with all of its candidates: their whole sets of word hashes are fetched once a class and compared where
the lists are (after a filter of 1,024 parity bits), so that no pairs travel but one confirmed one a class, whose lines are then verified like any others.

Null and empty texts have no lines to compare. Rows without doc_id are never compared and stay. Rows that share a doc_id are
texts of their own; rows equal in doc_id and text are one text and lose the same lines. Columns other than doc_id, text and n_chars pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import slices, trimmed
from .common import by_size, fresh, materialize
from .setsketch import mix
from .words import Words, byte_slices

MIN_WORDS = 1
PER_HUNDRED = 80
#: Counters of word rarity, as a power of two; the driver and each Python worker hold them in one byte each.
RARITY_BITS = 23
_SLICE = 1 << 16
BROADCAST_IDS = 1_000_000
#: Removed lines are broadcast to the rewrite up to this number (4 bytes each, 16 more counted per document).
BROADCAST_LINES = 8_000_000
#: Earlier candidates of a class that one list gives to verification.
BEST = 4
#: Postings of a word that are compared in one place; longer lists are dealt in blocks.
LIST_ROWS = 20_000
#: Postings of a bucket, on average, and those that a task gathers before it sends them.
BUCKET_ROWS, SEND_ROWS = 200_000, 250_000
#: Parity bits of the classes that are asked for again.
WIDE_BITS = 1024


def line_sets(text: str | None) -> list[list[bytes]]:
    return [line.split() for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")]


def _level(counts: np.ndarray) -> np.ndarray:
    """A byte that grows with the count: exact to 32, then eight steps per doubling."""
    return np.where(counts <= 32, counts, np.minimum(255, 32 + np.log2(np.maximum(counts, 1) / 32) * 8)).astype(np.uint8)


def _rarity(docs: DataFrame, bits: int) -> np.ndarray:
    """For each counter the level of how often its words occur in all texts; one byte a counter reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = Words(), np.zeros(1 << bits, np.int32)
        for _, texts in byte_slices(batches, 0):
            place, n = np.unique((words.of(texts)[0] & np.uint64((1 << bits) - 1)).astype(np.int64), return_counts=True)
            total[place] += n.astype(np.int32)
        rows = []
        for i, x in enumerate(total.reshape(-1, min(_SLICE, 1 << bits))):
            if len(at := np.flatnonzero(x)):
                rows.append((i, at.astype("<u2").tobytes(), x[at].astype("<i8").tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["slice", "places", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, at, n in zip(*(b.column(c).to_pylist() for c in range(3))):
                sums.setdefault(i, np.zeros(_SLICE, np.int64))[np.frombuffer(at, "<u2")] += np.frombuffer(n, "<i8")
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([_level(x).tobytes() for x in sums.values()], pa.binary())], names=["slice", "levels"])

    rows = docs.select("text").mapInArrow(trimmed(count), "slice int, places binary, counts binary").repartition("slice").mapInArrow(trimmed(add), "slice int, levels binary")
    out = np.zeros((max(1, (1 << bits) // _SLICE), min(_SLICE, 1 << bits)), np.uint8)
    for r in rows.collect():
        out[r["slice"]] = np.frombuffer(r["levels"], np.uint8)[: out.shape[1]]
    return out.reshape(-1)


def _signatures(docs: DataFrame, shared: Broadcast, min_words: int, per_hundred: int) -> DataFrame:
    """Per text and class of its lines: doc, version (a hash of the text), lines (their places), h0, h1, n, prefix (word hashes by rarity, 0 where nobody else has the word), b0, b1.

    h0 and h1 are two sums over independent hashes of the distinct words. b0 and b1 are 128 bits, each the parity of the words that
    fall on it: bits that differ between two sets bound their symmetric difference.
    """
    schema = "doc long, version long, lines array<int>, h0 long, h1 long, n int, prefix array<int>, b0 long, b1 long"
    names = ["doc", "version", "lines", "h0", "h1", "n", "prefix", "b0", "b1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity, words = shared.value, Words()
        zero, slots = np.uint64(0), np.uint64(len(rarity) - 1)
        for part, texts in byte_slices(batches, 2):
            h, text, line = words.of(texts)
            if not len(h):
                continue
            new = np.concatenate([[True], (text[1:] != text[:-1]) | (line[1:] != line[:-1])])
            of = np.cumsum(new) - 1  # number of the line among lines with words
            owner, place = text[new], line[new]
            rare = rarity[(h & slots).astype(np.int64)]
            # by line, rarity and hash: in one key, if that tells all words of a line apart
            key = (of.astype(np.uint64) << np.uint64(46)) | (rare.astype(np.uint64) << np.uint64(38)) | (h & np.uint64((1 << 38) - 1))
            order = np.argsort(key)
            key, g = key[order], h[order]
            if len(owner) > 1 << 18 or ((key[1:] == key[:-1]) & (g[1:] != g[:-1])).any():
                order = np.lexsort((h, rare, of))
                g = h[order]
            h, of, rare = g, of[order], rare[order]
            once = np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])])
            h, of, rare = h[once], of[once], rare[once]
            n = np.bincount(of, minlength=len(owner))
            begin = np.cumsum(n) - n
            h0, h1 = (np.add.reduceat(mix(h ^ np.uint64(c)), begin) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
            bit = (h >> np.uint64(32)) & np.uint64(127)
            one = np.uint64(1) << (bit & np.uint64(63))
            b0, b1 = (np.bitwise_xor.reduceat(np.where(side, one, zero), begin) for side in (bit < 64, bit >= 64))
            posted = np.where(rare <= 1, np.uint32(0), np.maximum((h & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.uint32(1))).view(np.int32)
            # where one more word is too many only equal sets match, and these are one class
            length = np.where(100 * n < per_hundred * (n + 1), 0, n - (per_hundred * n + 99) // 100 + 1)
            # a text's lines of one class are one row, its first line leads
            own = np.flatnonzero(n >= min_words)
            own = own[np.lexsort((place[own], h1[own], h0[own], owner[own]))]
            if not len(own):
                continue
            fresh_row = np.concatenate([[True], (owner[own[1:]] != owner[own[:-1]]) | (h0[own[1:]] != h0[own[:-1]]) | (h1[own[1:]] != h1[own[:-1]])])
            starts = np.flatnonzero(fresh_row)
            lead = own[starts]
            taken = np.concatenate([[0], np.cumsum(length[lead])])
            flat = np.repeat(begin[lead] - taken[:-1], length[lead]) + np.arange(taken[-1])
            lists = [pa.ListArray.from_arrays(pa.array(np.append(o, len(v)).astype(np.int32)), pa.array(v)) for o, v in ((starts, place[own].astype(np.int32)), (taken[:-1], posted[flat]))]
            ids = [part.column(c).take(pa.array(owner[lead])) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*ids, lists[0], *(pa.array(x[lead].view(np.int64)) for x in (h0, h1)), pa.array(n[lead].astype(np.int32)), lists[1], *(pa.array(x[lead].view(np.int64)) for x in (b0, b1))], names=names)

    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("version"), "text")
    return rows.mapInArrow(trimmed(run), schema)


def _classes(sig: DataFrame) -> DataFrame:
    """One row per distinct set: c (its number, in the order of first places), doc, line, version, copies (rows of sig), and the signature."""
    rows = sig.select("h0", "h1", F.struct("doc", F.element_at("lines", 1).alias("line"), "version").alias("at"), "n", "prefix", "b0", "b1", F.size("lines").alias("k"))
    by = rows.groupBy("h0", "h1").agg(F.min("at").alias("at"), F.sum("k").alias("copies"), *[F.any_value(c).alias(c) for c in ("n", "prefix", "b0", "b1")])
    by = by.select("at.*", "h0", "h1", "copies", "n", "prefix", "b0", "b1")
    return by.repartitionByRange("doc", "line", "version").sortWithinPartitions("doc", "line", "version", "h0").select(F.monotonically_increasing_id().alias("c"), "*")


def _slot(token: np.ndarray, part: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(token.astype(np.uint64) | part.astype(np.uint64) << np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per posting of a batch of classes: number of the class in the batch, place in the prefix, word."""
    prefix = batch.column("prefix").combine_chunks() if isinstance(batch.column("prefix"), pa.ChunkedArray) else batch.column("prefix")
    size = np.diff(prefix.offsets.to_numpy())
    token = prefix.flatten().to_numpy().view(np.uint32)
    row = np.repeat(np.arange(batch.num_rows), size)
    pos = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
    on = token != 0
    return row[on], pos[on], token[on]


def _long_lists(classes: DataFrame, shared: Broadcast, list_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, blocks): prefix words posted over list_rows times, sorted, and into how many blocks each one's list is dealt.

    All postings are counted, of the words that the counters allow: a word over list_rows times in the lists is so often in the texts, too. A task sends one count of a word and
    slice. The words' number is that of the postings / list_rows at most.
    """
    least = _level(np.array([list_rows]))[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shared.value
        for b in batches:
            token = _tokens(b)[2]
            token = token[rarity[token & np.uint32(len(rarity) - 1)] >= least]
            if len(token):
                word, n = np.unique(token, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    counts = classes.select("prefix").mapInArrow(trimmed(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") > list_rows)
    rows = counts.orderBy("word").collect()
    return np.array([r["word"] for r in rows], np.uint32), np.array([-(-r["n"] // list_rows) for r in rows], np.int64)


def _postings(classes: DataFrame, long: tuple[np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """classes -> (bucket, rows, packed, bits): the postings of a bucket of words, as many as a task gathered.

    long: the words with long lists and their blocks.
    """
    hot, blocks = long

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def send():
            cols = [np.concatenate(x) for x in zip(*held)]
            held.clear()
            bucket = _slot(cols[0], cols[1], buckets)
            order = np.argsort(bucket, kind="stable")
            cols, bucket = [x[order] for x in cols], bucket[order]
            cuts = [*np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist(), len(bucket)]
            out = []
            for s, e in zip(cuts, cuts[1:]):
                token, part, side, c, n, pos, b0, b1 = (x[s:e] for x in cols)
                body = b"".join([np.diff(c, prepend=0).astype("<i8").tobytes(), n.astype("<i4").tobytes(), pos.astype("<i4").tobytes(), part.astype("<u4").tobytes(), side.astype("<u1").tobytes()])
                out.append((int(bucket[s]), e - s, pa.compress(body, codec="zstd", asbytes=True), token.astype("<u4").tobytes() + b0.tobytes() + b1.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "rows", "packed", "bits"])

        gathered = 0
        for b in batches:
            row, pos, token = _tokens(b)
            if not len(row):
                continue
            c, n, b0, b1 = (b.column(x).to_numpy() for x in ("c", "n", "b0", "b1"))
            part = side = np.zeros(len(row), np.int64)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, token), len(hot) - 1)
                k = np.where(hot[at] == token, blocks[at], 1)
                mine = (mix(c.astype(np.uint64))[row] % k.astype(np.uint64)).astype(np.int64)
                rep = np.repeat(np.arange(len(row)), k)
                other = np.arange(len(rep)) - np.repeat(np.cumsum(k) - k, k)
                row, pos, token, mine, k = row[rep], pos[rep], token[rep], mine[rep], k[rep]
                lo, hi = np.minimum(mine, other), np.maximum(mine, other)
                part, side = lo * k + hi, np.where(lo == hi, 0, np.where(mine == lo, 1, 2))
            held.append([token, part, side, c[row], n[row], pos, b0[row], b1[row]])
            gathered += len(row)
            if gathered >= SEND_ROWS:
                yield from send()
                gathered = 0
        if held:
            yield from send()

    return classes.select("c", "n", "b0", "b1", "prefix").mapInArrow(trimmed(run), "bucket long, rows int, packed binary, bits binary")


def _walk(key: np.ndarray, side: np.ndarray, c: np.ndarray, n: np.ndarray, pos: np.ndarray, b0: np.ndarray, b1: np.ndarray, per_hundred: int, wanted: np.ndarray | None = None):
    """(i, j, differing bits, words of both) of the pairs of a list's rows that pass the filters, j later than i; by their distance in the list. Rows are sorted by key and c.

    At the first word that two sets share, in the order of rarity, what is left of either one must hold all of what they need to share; so a
    pair that matches is found at that word, and one that fails there is found at no other. wanted: only these rows are looked at as j.
    """
    left = ((100 + per_hundred) * (n - pos)).astype(np.int32)  # at most this much can be shared from here on
    size = (per_hundred * n).astype(np.int32)
    n = n.astype(np.int32)
    lone = not side.any()
    # within a list rows are sorted by number, so i is earlier than i + d; `ends` is where each row's list ends
    ends = np.searchsorted(key, key, side="right")
    live, d = np.arange(len(key)), 0
    while True:
        d += 1
        live = live[ends[live] > live + d]
        if not len(live):
            break
        i, j = live, live + d
        if wanted is not None:
            on = wanted[j]
            i, j = i[on], j[on]
        on = np.minimum(left[i], left[j]) >= size[i] + size[j]
        if not lone:
            on &= (side[i] != side[j]) | (side[i] == 0)
        i, j = i[on], j[on]
        apart = np.bitwise_count(b0[i] ^ b0[j]).astype(np.int32) + np.bitwise_count(b1[i] ^ b1[j])
        both = n[i] + n[j]
        # what they share is half of (both - symmetric difference) at most
        on = (100 + per_hundred) * ((both - apart) // 2) >= per_hundred * both
        if on.any():
            yield i[on], j[on], apart[on], both[on]


def _candidates(postings: DataFrame, per_hundred: int, best: int) -> DataFrame:
    """(x later, y earlier, score, more): pairs of classes that pass the filters, the most alike `best` of each later one in a list; more: it had others there."""
    names = ["x", "y", "score", "more"]

    def found(rows: list[tuple[int, bytes, bytes]]):
        cols = [[] for _ in range(8)]
        for m, packed, bits in rows:
            body = pa.decompress(packed, decompressed_size=21 * m, codec="zstd", asbytes=True)
            cols[0].append(np.frombuffer(bits, "<u4", m))
            cols[1].append(np.frombuffer(body, "<u4", m, 16 * m))
            cols[2].append(np.frombuffer(body, "<u1", m, 20 * m))
            cols[3].append(np.cumsum(np.frombuffer(body, "<i8", m)))
            cols[4].append(np.frombuffer(body, "<i4", m, 8 * m))
            cols[5].append(np.frombuffer(body, "<i4", m, 12 * m))
            for k in (0, 1):
                cols[6 + k].append(np.frombuffer(bits, "<u8", m, 4 * m + 8 * k * m))
        token, part, side, c, n, pos, b0, b1 = (np.concatenate(x) for x in cols)
        key = token.astype(np.uint64) | part.astype(np.uint64) << np.uint64(32)
        order = np.lexsort((c, key))
        key, side, c, n, pos, b0, b1 = (x[order] for x in (key, side, c, n, pos, b0, b1))
        ys, scores, seen = np.full((best, len(key)), -1, np.int64), np.full((best, len(key)), np.inf, np.float32), np.zeros(len(key), np.int32)
        for i, j, apart, both in _walk(key, side, c, n, pos, b0, b1, per_hundred):
            score = (apart / both).astype(np.float32)
            seen[j] += 1
            worst = scores[:, j].argmax(0)
            better = score < scores[worst, j]
            worst, j = worst[better], j[better]
            scores[worst, j], ys[worst, j] = score[better], c[i[better]]
        k, j = np.nonzero(ys >= 0)
        if len(j):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((c[j], ys[k, j], scores[k, j], seen[j] > best), (pa.int64(), pa.int64(), pa.float32(), pa.bool_()))], names=names)

    def run(batches):
        held, last = [], None
        for b in batches:
            for bucket, *row in zip(*(b.column(x).to_pylist() for x in ("bucket", "rows", "packed", "bits"))):
                if bucket != last and held:
                    yield from found(held)
                    held = []
                last = bucket
                held.append(row)
        if held:
            yield from found(held)

    return postings.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(run), "x long, y long, score float, more boolean")


def _asked_lists(classes: DataFrame, asked: DataFrame, list_rows: int, broadcast_ids: int) -> DataFrame:
    """(word, i, j, side, c, n, pos, b0, b1, asked): the postings of all words in the prefixes of the asked classes; lists of over list_rows are dealt in blocks."""
    own = by_size(asked.select("c").withColumn("asked", F.lit(True)), "line-asked", broadcast_ids)
    posts = lambda df: df.withColumn("at", F.explode(F.expr("transform(prefix, (w, i) -> named_struct('word', w, 'pos', i))"))).where("at.word <> 0")
    words = by_size(posts(classes.select("c", "prefix").join(own, "c", "left_semi")).select("at.word").distinct(), "line-words-asked", broadcast_ids)
    posted = posts(classes.select("c", "n", "b0", "b1", "prefix")).select("c", "n", "b0", "b1", "at.word", "at.pos").join(words, "word", "left_semi")
    posted = materialize(posted.join(own, "c", "left").withColumn("asked", F.coalesce("asked", F.lit(False))), "line-lists")
    long = posted.groupBy("word").agg(F.ceil(F.count(F.lit(1)) / list_rows).cast("int").alias("k")).where("k > 1")
    k = F.coalesce("k", F.lit(1))
    dealt = posted.join(by_size(long, "line-long", broadcast_ids), "word", "left").withColumn("mine", F.pmod(F.xxhash64("c"), k).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), k - 1)))
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    return dealt.select("word", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), side.alias("side"), "c", "n", "pos", "b0", "b1", "asked")


def _each_list(batches: Iterator[pa.RecordBatch], rows: int = 20_000, size: int = 16 << 20):
    """Tables of whole lists, several at a time, sorted by list and class; with the lists' keys."""
    held: list[pa.RecordBatch] = []
    n = used = 0
    last = None

    def table():
        t = pa.Table.from_batches(held)
        word, i, j = (t.column(x).to_numpy() for x in ("word", "i", "j"))
        new = np.concatenate([[True], (word[1:] != word[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        return t, np.cumsum(new)

    for b in batches:
        key = np.stack([b.column(x).to_numpy().astype(np.int64) for x in ("word", "i", "j")])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            if e > s:
                now = tuple(key[:, s].tolist())
                if held and now != last and (n >= rows or used >= size):
                    yield table()
                    held, n, used = [], 0, 0
                last = now
                part = b.slice(s, e - s)
                held.append(part)
                n, used = n + e - s, used + part.get_total_buffer_size() * (e - s) // max(1, b.num_rows)
    if held:
        yield table()


def _grouped(lists: DataFrame) -> DataFrame:
    return lists.repartition("word", "i", "j").sortWithinPartitions("word", "i", "j", "c")


def _walked(t: pa.Table, key: np.ndarray, per_hundred: int, c: np.ndarray, wanted: np.ndarray):
    n, pos, side = (t.column(x).to_numpy() for x in ("n", "pos", "side"))
    b0, b1 = (t.column(x).to_numpy().view(np.uint64) for x in ("b0", "b1"))
    return _walk(key, side, c, n, pos, b0, b1, per_hundred, wanted)


def _involved(lists: DataFrame, per_hundred: int) -> DataFrame:
    """(c): the classes of any pair that passes the filters, once a task."""

    def run(batches):
        for t, key in _each_list(batches):
            c, wanted = t.column("c").to_numpy(), t.column("asked").to_numpy()
            on = np.zeros(len(c), bool)
            for i, j, *_ in _walked(t, key, per_hundred, c, wanted):
                on[i] = on[j] = True
            if on.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(c[on]))], names=["c"])

    return _grouped(lists).mapInArrow(trimmed(run), "c long").distinct()


def _wide_bits(sets: list[np.ndarray]) -> np.ndarray:
    """WIDE_BITS parities of each set of word hashes."""
    out = np.zeros((len(sets), WIDE_BITS), bool)
    for r, h in enumerate(sets):
        np.logical_xor.at(out[r], (h >> np.uint64(40)).astype(np.int64) % WIDE_BITS, True)
    return np.packbits(out, axis=1).view(np.uint64)


def _confirmed(lists: DataFrame, sets: DataFrame, per_hundred: int) -> DataFrame:
    """(x, y): for each asked class and list an earlier one that its whole set of word hashes matches, if there is any. Pairs don't leave the task."""

    def run(batches):
        for t, key in _each_list(batches):
            c, wanted, n = t.column("c").to_numpy(), t.column("asked").to_numpy(), t.column("n").to_numpy().astype(np.int64)
            unique, of = np.unique(c, return_inverse=True)
            raw = t.column("hashes").to_pylist()
            held = [np.zeros(0, np.uint64)] * len(unique)
            for row, u in enumerate(of.tolist()):
                if not len(held[u]):
                    held[u] = np.frombuffer(raw[row], "<u8")
            del raw
            bits, done, pairs = _wide_bits(held), np.zeros(len(unique), bool), []
            for i, j, _, both in _walked(t, key, per_hundred, c, wanted):
                on = ~done[of[j]]
                i, j, both = i[on], j[on], both[on]
                apart = np.bitwise_count(bits[of[i]] ^ bits[of[j]]).sum(1).astype(np.int64)
                on = (100 + per_hundred) * ((both - apart) // 2) >= per_hundred * both
                for x, y in zip(j[on].tolist(), i[on].tolist()):
                    if not done[of[x]]:
                        common = len(np.intersect1d(held[of[x]], held[of[y]], assume_unique=True))
                        if 100 * common >= per_hundred * (n[x] + n[y] - common):
                            done[of[x]] = True
                            pairs.append((int(c[x]), int(c[y])))
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*pairs)], names=["x", "y"])

    return _grouped(lists.join(sets, "c")).mapInArrow(trimmed(run), "x long, y long").distinct()


def _lines_of(ids: DataFrame, classes: DataFrame, docs: DataFrame, broadcast_ids: int) -> DataFrame:
    """(c, text): a line of each class of ids; only these lines are moved."""
    ids = by_size(ids, "line-ids", broadcast_ids)
    wanted = classes.select("c", "doc", "line", "version").join(ids, "c")
    wanted = wanted.groupBy("doc", "version").agg(F.collect_list(F.struct("line", "c")).alias("wanted"))  # a text's lines
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("version"), "text").dropna()
    parts = texts.join(by_size(wanted, "line-texts", broadcast_ids, F.size("wanted")), ["doc", "version"]).select("wanted", F.split("text", "\n").alias("parts"))
    return parts.select(F.inline(F.expr("transform(wanted, w -> named_struct('c', w.c, 'text', parts[w.line]))"))).dropDuplicates(["c"])


def _hash_sets(lines: DataFrame) -> DataFrame:
    """(c, hashes): the sorted hashes of each line's words."""

    def run(batches):
        words = Words()
        for part, texts in byte_slices(batches, 1):
            h, text, _ = words.of(texts)
            cuts = np.searchsorted(text, np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([np.unique(h[s:e]).astype("<u8").tobytes() for s, e in zip(cuts, cuts[1:])], pa.binary())], names=["c", "hashes"])

    return lines.select("c", "text").mapInArrow(trimmed(run), "c long, hashes binary")


def _second_round(classes: DataFrame, docs: DataFrame, asked: DataFrame, per_hundred: int, list_rows: int, broadcast_ids: int) -> DataFrame:
    """(x): the asked classes (c) that any earlier class matches. The sets of all classes that may match one are fetched once, and compared where their lists are."""
    lists = materialize(_asked_lists(classes, asked, list_rows, broadcast_ids), "asked-lists")
    involved = materialize(_involved(lists, per_hundred), "involved")
    sets = materialize(_hash_sets(_lines_of(involved, classes, docs, broadcast_ids)), "line-sets")
    pairs = materialize(_confirmed(lists, sets, per_hundred), "line-pairs-2")
    # one pair of each class is enough, and it is verified like any other
    return _verified(pairs.groupBy("x").agg(F.min("y").alias("y")), classes, docs, per_hundred, broadcast_ids).select("x").distinct()


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, per_hundred: int, broadcast_ids: int) -> DataFrame:
    """The pairs (x, y) whose lines' full word sets reach the similarity; only lines of a pair are moved."""
    ids = pairs.select(F.explode(F.array("x", "y")).alias("c")).distinct()
    lines = materialize(_lines_of(ids, classes, docs, broadcast_ids), "line-words")
    side = lambda s: lines.select(F.col("c").alias(s), F.col("text").alias(f"{s}_text"))
    both = pairs.select("x", "y").join(side("x"), "x").join(side("y"), "y")

    def run(batches):
        for part in slices(batches):
            ok = []
            for a, b in zip(part.column("x_text").to_pylist(), part.column("y_text").to_pylist()):
                a, b = (set(t.encode("utf-8", "surrogatepass").lower().split()) for t in (a, b))
                common = len(a & b)
                ok.append(100 * common >= per_hundred * (len(a) + len(b) - common))
            yield part.select(["x", "y"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(trimmed(run), "x long, y long")


def _matched(classes: DataFrame, docs: DataFrame, shared: Broadcast, per_hundred: int, broadcast_ids: int, best: int, list_rows: int) -> DataFrame:
    """(x): numbers of the classes that an earlier class matches."""
    postings = int(classes.agg(F.sum(F.size("prefix"))).first()[0] or 0)
    buckets, long = max(1, postings // BUCKET_ROWS), _long_lists(classes, shared, list_rows)
    pairs = _candidates(_postings(classes, long, buckets), per_hundred, best)
    # the same pair comes from several lists
    pairs = materialize(pairs.groupBy("x", "y").agg(F.bool_or("more").alias("more")), "line-pairs")
    matched = materialize(_verified(pairs, classes, docs, per_hundred, broadcast_ids).select("x").distinct(), "line-matches")
    left = materialize(pairs.where("more").select("x").distinct().join(matched, "x", "left_anti"), "line-open")
    if left.isEmpty():
        return matched
    return matched.unionByName(_second_round(classes, docs, left.withColumnRenamed("x", "c"), per_hundred, list_rows, broadcast_ids))


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS, per_hundred: int = PER_HUNDRED, rarity_bits: int = RARITY_BITS, broadcast_ids: int = BROADCAST_IDS, best: int = BEST, list_rows: int = LIST_ROWS) -> DataFrame:
    """doc, version, removed array<int> (sorted places of removed lines), for texts that lose a line."""
    shared = docs.sparkSession.sparkContext.broadcast(_rarity(docs, rarity_bits))
    sig = materialize(_signatures(docs, shared, min_words, per_hundred), "lines")
    classes = materialize(_classes(sig), "classes")
    later = _matched(classes, docs, shared, per_hundred, broadcast_ids, best, list_rows).select(F.col("x").alias("c"), F.lit(True).alias("later"))
    # only classes that lose a line are joined back: those with an earlier match lose all, others all but their first one
    losing = classes.select("c", "h0", "h1", "copies", F.col("doc").alias("f_doc"), F.col("version").alias("f_version"), F.col("line").alias("f_line")).join(later, "c", "left").where("later OR copies > 1").drop("c", "copies")
    placed = sig.select("doc", "version", "lines", "h0", "h1").join(by_size(losing, "losing", broadcast_ids), ["h0", "h1"])
    gone = F.expr("CASE WHEN later OR doc <> f_doc OR version <> f_version THEN lines ELSE array_remove(lines, f_line) END")
    lost = placed.select("doc", "version", gone.alias("gone")).where(F.size("gone") > 0)
    return lost.groupBy("doc", "version").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("removed"))


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines (all lines of the text), n_removed, removed_lines (places from 0, comma-joined) for every row."""
    n_lines = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split("text", "\n"))).cast("long")
    rows = docs.select("doc_id", n_lines.alias("n_lines"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("version"))
    joined = rows.join(removed_lines(docs, **options), ["doc", "version"], "left")
    return joined.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed_lines"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """The input's columns with removed lines cut out of the texts; n_chars follows. A text of which no word is left goes as a whole, if lines were removed from it."""
    key, version, removed, left = fresh(docs, "doc", "version", "removed", "text")
    lost = by_size(removed_lines(docs, **options).toDF(key, version, removed), "removed", BROADCAST_LINES, F.size(removed) + 16)
    joined = docs.join(lost, (docs["doc_id"].cast("long") == F.col(key)) & (F.xxhash64(docs["text"]) == F.col(version)), "left")
    kept = F.expr(f"CASE WHEN {removed} IS NULL THEN text ELSE array_join(filter(split(text, '\n'), (x, i) -> NOT array_contains({removed}, i)), '\n') END")
    joined = joined.withColumn(left, kept).where(f"{removed} IS NULL OR {left} RLIKE '[^ \\t-\\r]'")
    new = {"text": F.col(left)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(removed).isNull(), F.col("n_chars")).otherwise(F.length(left).cast(docs.schema["n_chars"].dataType))
    return joined.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
